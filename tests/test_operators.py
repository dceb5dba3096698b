import json
import math

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from hornbeam.facade import Database
from hornbeam.operators import lifecycle, mutate, retrieval, temporal, text, vector
from hornbeam.sources import graph_files
from hornbeam.operators.stored import Log
from hornbeam.streaming import coordinator


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "a a x y"), (2, "a b b"), (3, "c d")], "doc_id long, text string")
    r = text.bm25_explain(docs, "A").filter("doc_id = 1").first()
    assert (r["tf"], r["df"], r["dl"], r["avgdl"]) == (2, 2, 4, 3.0)
    assert math.isclose(r["score"], 0.5908617, abs_tol=1e-6)


def test_bm25_edge_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Alice DATABASE 数据")], "doc_id long, text string")
    assert [r["doc_id"] for r in text.bm25(docs, "database 数").collect()] == [3]
    assert text.query_terms("Alice DATABASE alice") == ["alice", "database"]


def test_paragraph_ranges_slice_back():
    t = "# 标题\n\nFirst paragraph.\ncontinued\n\n第二段"
    chunks = text.paragraphs(t)
    assert [c.content for c in chunks] == ["# 标题", "First paragraph.\ncontinued", "第二段"]
    assert all(t.encode()[c.start : c.end].decode() == c.content for c in chunks)
    assert text.paragraphs("") == [] and text.whole_field(" ") == []


def test_windows_overlap():
    assert [c.content for c in text.token_windows("a b c d e", 3, 1)] == ["a b c", "c d e"]
    with pytest.raises(ValueError):
        text.token_windows("a", 2, 2)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<double>")
    assert [(r["doc_id"], round(r["score"], 3)) for r in vector.search(v, [2.0, 0.0], 2).collect()] == [(1, 1.0), (3, 0.6)]
    assert {r["vec_id"]: r["problem"] for r in vector.problems(v, 2).collect()} == {4: "zero", 5: "dimension"}
    assert {r["entity"]: round(r["score"], 2) for r in vector.similar(v.filter("vec_id < 4"), 1).collect()} == {2: 0.0, 3: 0.6}
    with pytest.raises(ValueError):
        vector.search(v, [0.0, 0.0])


def test_times():
    assert temporal.utc_micros("2026-03-08T01:30:00-05:00") == temporal.utc_micros("2026-03-08T06:30:00Z")
    with pytest.raises(ValueError):
        temporal.utc_micros("2026-01-01 12:00:00")


def test_validity_is_half_open(spark):
    v = spark.sql("select 1 id, timestamp'2026-01-01' valid_from, timestamp'2026-01-02' valid_to union all select 2, timestamp'2026-01-02', null")
    assert [r["id"] for r in temporal.valid_at(v, "2026-01-02").collect()] == [2]
    assert [r["id"] for r in temporal.valid_overlaps(v, "2026-01-01", "2026-01-02").collect()] == [1]


def test_overlap_join_matches_all_pairs(spark):
    import random

    r = random.Random(1)
    rows = [(i, i % 3, t := r.randrange(100), None if r.random() < 0.1 else t + r.randrange(1, 60)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k long, a long, b long").select("id", "k", F.timestamp_seconds("a").alias("valid_from"), F.timestamp_seconds("b").alias("valid_to"))
    got = {(x["left_id"], x["right_id"]) for x in temporal.overlap_join(df, df, ["k"], 10).collect()}
    inf = 10**9
    assert got == {(x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] < (y[3] or inf) and y[2] < (x[3] or inf)}


def test_rrf_counts_a_document_once(spark):
    one = spark.createDataFrame([("a", 3.0, 1), ("a", 2.0, 2), ("b", 1.0, 3)], "doc_id string, score double, rank int")
    two = spark.createDataFrame([("b", 9.0, 1)], "doc_id string, score double, rank int")
    got = {r["doc_id"]: r["fused_score"] for r in retrieval.fuse({"x": one, "y": two}).collect()}
    assert math.isclose(got["a"], 1 / 61) and math.isclose(got["b"], 1 / 63 + 1 / 61)


def test_hybrid_filters_then_cuts(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id string")
    fused = spark.createDataFrame([("alice", 0.9), ("bob", 0.8), ("fruit", 0.7)], "doc_id string, fused_score double")
    budget = retrieval.Budget(1, 3, 3, 1, 10)
    assert [r["doc_id"] for r in retrieval.filtered(fused, budget, ids("alice", "bob"), ids("bob", "fruit")).collect()] == ["bob"]
    s = retrieval.execution_stats(fused, budget, ids("alice", "bob"), ids("bob", "fruit")).first()
    assert (s["candidates"], s["time_rejected"], s["graph_rejected"], s["answers"]) == (2, 0, 1, 1)
    with pytest.raises(ValueError):
        retrieval.Budget(10, 5)


def test_facade_round_trip(spark, tmp_path):
    db = Database(spark)
    ok = lambda **r: db.handle(r)["data"]
    ok(command="add_node", id="a", labels=["person"], properties={"name": "Ann", "age": 30})
    ok(command="add_node", id="b", labels=["person"])
    ok(command="add_edge", edge_type="knows", source="a", target="b")
    assert db.handle({"command": "add_node", "id": "a", "labels": []})["type"] == "error"
    assert db.handle({"command": "nonsense"})["code"] == "ValueError"
    ok(command="set_node_property", id="b", key="age", value=31.5)
    assert ok(command="get_node", id="b")["properties"] == {"age": 31.5}
    before = ok(command="index_status")["sequence"]
    assert ok(command="set_node_property", id="b", key="age", value=31.5) == before
    ok(command="add_rules", text="older(X, Y) :- knows(Y, X), prop_age(X, A), prop_age(Y, B), '>'(A, B).")
    assert ok(command="query", query="? older(X, Y).") == [{"X": "b", "Y": "a"}]
    assert ok(command="query", query="? property(a, K, V).") == [{"K": "name", "V": "Ann"}, {"K": "age", "V": "30"}] or len(ok(command="query", query="? property(a, K, V).")) == 2
    ok(command="put_index_profile", name="p", version=1, labels=["person"], bm25={"name": 2.0})
    ok(command="activate_index_profile", name="p", version=1)
    assert [h["entity"] for h in ok(command="search", query="ann")] == ["a"]
    ok(command="delete_node", id="a")
    assert db.graph.edges.isEmpty()
    assert [r["kind"] for r in db.graph.outbox.orderBy("sequence").collect()][-2:] == ["delete", "delete"]


def test_patches_and_events(spark):
    g = mutate.create_nodes(mutate.Graph.empty(spark), spark.createDataFrame([("a", ["x"], {"k": "1"}), ("b", ["x"], {})], "id string, labels array<string>, properties map<string,string>"))
    g = mutate.patch_nodes(g, spark.createDataFrame([("a", {"n": "2"}, ["k"]), ("b", {}, ["zz"])], "id string, set map<string,string>, remove array<string>"))
    assert {r["id"]: (r["properties"], r["version"]) for r in g.nodes.collect()} == {"a": ({"n": "2"}, 2), "b": ({}, 1)}
    assert [r["sequence"] for r in g.outbox.orderBy("sequence").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        mutate.patch_nodes(g, spark.createDataFrame([("a", {"n": "2"}, ["n"])], "id string, set map<string,string>, remove array<string>"))
    with pytest.raises(ValueError):
        mutate.create_edges(g, spark.createDataFrame([("e", "t", "a", "zz", {}, 1)], mutate.EDGES))


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "labels": ["l"], "properties": {"k": 1}}, {"id": "bad"}], "edges": [{"type": "t", "source": "a", "target": "a"}, {"source": "a"}]}))
    nodes, edges = graph_files.read_graph_json(spark, str(tmp_path / "g.json"))
    assert [r["id"] for r in nodes.collect()] == ["a"] and [r["id"] for r in edges.collect()] == ["a:t:a"]
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("# Title\ntext\n## Two\nmore\n")
    nodes, edges = graph_files.read_markdown(spark, str(tmp_path / "md"))
    assert edges.count() == 2 and nodes.filter(F.array_contains("labels", "document")).first()["properties"]["title"] == "Title"
    (tmp_path / "f.pl").write_text("person(a). % note\nprop_age(a, 3). knows(a, 'B c').\n")
    facts = graph_files.read_facts(spark, str(tmp_path / "f.pl"))
    assert sorted((r["name"], r["a"], r["b"]) for r in facts.collect()) == sorted([("person", "a", None), ("prop_age", "a", "3"), ("knows", "a", "B c")], key=lambda r: r[0])
    with pytest.raises(ValueError, match="property facts"):
        graph_files.write_pack(facts, str(tmp_path / "pack"))
    graph_files.write_pack(facts.filter("name <> 'prop_age'"), str(tmp_path / "pack"))
    assert graph_files.read_pack(spark, str(tmp_path / "pack")).count() == 2
    tax = tmp_path / "tax"
    tax.mkdir()
    (tax / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tspecies\t|\n")
    (tax / "names.dmp").write_text("2\t|\tHomo\t|\t\t|\tscientific name\t|\n2\t|\tMan\t|\t\t|\tcommon name\t|\n")
    taxa, parents = graph_files.read_taxonomy(spark, str(tax))
    assert [tuple(r) for r in parents.collect()] == [("tax_2", "tax_1")] and taxa.filter("tax_id = 2").first()["scientific_name"] == "Homo"


def test_streaming_skips_stale_and_stops_at_poison(spark, tmp_path):
    box = spark.createDataFrame([(1, "node", "a", 1, "upsert", ["k"]), (2, "node", "a", 2, "upsert", ["k"]), (3, "node", "b", 1, "delete", [])], mutate.OUTBOX)
    box.coalesce(1).write.parquet(str(tmp_path / "box"))
    seen = []
    target = coordinator.Target("t", lambda df, i: seen.extend(r["sequence"] for r in df.orderBy("sequence").collect()))
    coordinator.start(spark, str(tmp_path / "box"), str(tmp_path / "cp"), target).awaitTermination()
    assert seen == [2, 3] and target.published == 3 and target.stale == 1
    coordinator.start(spark, str(tmp_path / "box"), str(tmp_path / "cp"), target).awaitTermination()
    assert seen == [2, 3]

    def fail(df, i):
        raise RuntimeError("no")

    state = Log(spark, str(tmp_path / "state"))
    bad = coordinator.Target("bad", fail, attempts=2, state=state)
    with pytest.raises(StreamingQueryException):
        coordinator.start(spark, str(tmp_path / "box"), str(tmp_path / "cp2"), bad).awaitTermination()
    assert bad.dead and coordinator.pending([target, bad], 3) == ["bad"] == coordinator.wait([target, bad], 3, 30)
    # Started again with a target that is well, the same batch is applied, once.
    seen.clear()
    for _ in range(2):
        well = coordinator.Target("bad", lambda df, i: seen.extend(r["sequence"] for r in df.orderBy("sequence").collect()), state=state)
        coordinator.start(spark, str(tmp_path / "box"), str(tmp_path / "cp2"), well).awaitTermination()
        assert seen == [2, 3] and well.published == 3 and not well.dead


def test_generations():
    g = lifecycle.Generations()
    one, two = g.create(), g.create()
    for x in (one, two):
        for step in ("build", "validate", "activate"):
            g.act(step, x)
    assert g.active == two and g.states[one] == "retired"
    g.act("rollback", one)
    assert g.active == one
    with pytest.raises(ValueError):
        g.act("activate", two)


def test_jobs(spark):
    jobs = spark.createDataFrame([("a", 2, "pending", 0, None, None), ("b", 1, "leased", 0, 5, None), ("c", 3, "retry", 1, None, 99)], "document_id string, created_at long, state string, attempts int, leased_until long, not_before long")
    out = {r["document_id"]: r["state"] for r in lifecycle.claim_jobs(jobs, 10, 5).collect()}
    assert out == {"a": "leased", "b": "leased", "c": "retry"}


def test_chunks_come_in_small_batches():
    import pyarrow as pa

    from hornbeam.operators import text

    texts = [None, "", "a b c " * 500, "one\n\ntwo"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["k", "text"])
    for f in (text.whole_field, text.paragraphs, lambda t: text.token_windows(t, 5, 1)):
        got = list(text.chunk_slices([batch], f, 10_000))
        assert len(got) > 5 and all(sum(map(len, b.column(5).to_pylist())) < 14_000 for b in got)
        rows = [r for b in got for r in zip(*(c.to_pylist() for c in b.columns))]
        assert rows == [(i, *c.__dict__.values()) for i, t in enumerate(texts) if t is not None for c in f(t)]
