import re

import numpy as np

from hornbeam.llm.quality import FEATURES, grow, quality_rules, statistics, train

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts(odd_rows):
    texts = [r[1] or "" for r in odd_rows] + ["a b c d e f g h a b c d e f g h", "x\x0by\x1fz   w", "p q r s t u v w p q r s t u v"]
    base, x = statistics([t.encode() for t in texts])
    assert [tuple(int(base[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [brute(t) for t in texts]
    assert x.shape == (len(texts), len(FEATURES)) and np.isfinite(x).all()


def test_trees_are_monotonic_and_accurate():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] + 0.3 * x[:, 2] + 0.2 * rng.standard_normal(4000)) < 0.7).astype(float)
    f = grow(x[:3000], y[:3000], [-1, 0, 0])
    assert ((f.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.8
    probe = np.repeat(rng.random((50, 3)), 40, 0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(f.margin(probe).reshape(50, 40), axis=1) <= 1e-12).all()


def test_one_sided_labels_accept_by_the_prior():
    x = np.zeros((5, 2))
    assert grow(x, np.ones(5), [0, 0]).probability(x).min() > 0.5
    assert grow(x, np.zeros(5), [0, 0]).probability(x).max() < 0.5
    assert grow(x[:0], np.zeros(0), [0, 0]).probability(x).min() > 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = train(spark, docs, labels.filter("doc_id % 2 = 0"))
    held = docs.join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    p = forest.probability(statistics([t.encode() for t in held.text])[1]) >= 0.5
    assert (p == (held.quality == 1)).mean() > 0.95


def test_odd_rows(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(4, 1), (12, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality_rules(spark, odd, labels).collect()
    assert len(rows) == len(odd_rows)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert quality_rules(spark, none, labels.limit(0)).count() == 0


def test_repeated_ids_dont_multiply_the_training_rows(spark, monkeypatch):
    from hornbeam.llm import quality

    seen = []
    monkeypatch.setattr(quality, "grow", lambda x, y, d, **k: seen.append((len(x), x.sum())) or grow(x, y, d, **k))
    rows = [(i % 3, f"text number {i} of id {i % 3}") for i in range(300)]
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1)] * 5, "doc_id long, quality int")
    for n in (1, 7):
        train(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, max_train=10)
    assert seen[0][0] == 3 and seen[0] == seen[1]
