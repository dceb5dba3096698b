import pytest

import corpus_pipeline
from hornbeam.llm.quality import quality_rules

from .test_line_dedup import brute as line_brute
from .test_near_dup import brute as near_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_the_columns(spark, odd, odd_rows):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert out.filter("doc_id is null").count() >= 1, name


def test_each_stage_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in quality_rules(spark, docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).collect()} == kept
    lines = corpus_pipeline.line_dedup(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, lines), key=repr) == line_brute(rows, 10)
    near = near_brute([(i, t) for i, t, _ in rows])
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {i for i, c in near.items() if i == c}


def test_run_keeps_clean_documents(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)


def test_decisions_apply_to_rows_without_an_id(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    kept = [r["text"] for r in docs.join(quality_rules(spark, docs, labels).filter("kept").select("doc_id"), "doc_id").orderBy("doc_id").collect()]
    prose = kept[0]
    texts = [prose, prose, prose.upper(), "too short", None, None, f"{bench} and more", " "]
    rows = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    left = lambda df: sorted((r["text"] for r in df.filter("doc_id is null").collect()), key=repr)
    assert others and {"too short", None, " "}.isdisjoint(left(corpus_pipeline.quality(spark, docs.union(rows), SF)))
    near = corpus_pipeline.near_dedup(spark, rows, SF)
    assert near.columns == docs.columns and near.filter("doc_id is not null").count() == 0
    assert len([t for t in left(near) if t and t.lower() == prose.lower()]) == 1 and left(near).count(None) == 2 and " " in left(near)
    with_id = rows.limit(0).union(docs.filter(F.col("text") == prose).limit(1)).union(rows)
    assert not [t for t in left(corpus_pipeline.near_dedup(spark, with_id, SF)) if t and t.lower() == prose.lower()]
    clean = corpus_pipeline.decontaminate(spark, rows, SF)
    assert f"{bench} and more" not in left(clean) and "too short" in left(clean) and left(clean).count(None) == 2


def test_last_stages_against_brute_force(spark, docs):
    """Decontamination keeps what holds no item's words in a row; the mix meets the targets of what is there."""
    import re
    from collections import Counter

    from hornbeam.llm.mixing import reshared_targets

    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = docs.collect()
    clean = {r["doc_id"] for r in rows if not any(i in words(r["text"]) for i in items)}
    assert {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()} == clean and 0 < len(clean) < len(rows)
    got = corpus_pipeline.mix(spark, docs, SF).collect()
    size = {r["doc_id"]: len(re.findall("[^ \t\n\x0b\x0c\r]+", r["text"] or "")) for r in rows}
    sources = sorted({r["source"] for r in rows})
    total, taken = Counter(), Counter()
    for r in rows:
        total[r["source"]] += size[r["doc_id"]]
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    want = reshared_targets([total[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))])
    assert [taken[s] for s in sources] == [round(t) for t in want] and len(got) == len(rows)
