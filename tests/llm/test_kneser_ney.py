import collections
import math
import zlib

from hornbeam.llm import kneser_ney as kn


def brute(rows):
    """doc_id -> (score, base score, tokens, known) by plain counting."""
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    train = [w for i, w in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    uni = collections.Counter(x for w in train for x in w)
    bi = collections.Counter(p for w in train for p in zip(["<s>", *w], w))
    left = collections.Counter(b for _, b in bi)
    d1, d2 = (kn.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (left, bi))
    n, v, types = sum(uni.values()), len(uni), len(bi)
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0
    gamma = sum(cut(d1, c) for c in left.values()) / types
    ctx = collections.defaultdict(list)
    for (a, _), c in bi.items():
        ctx[a].append(c)

    def p(a, w):
        one = (left[w] - cut(d1, left[w])) / types + gamma / (v + 1)
        if a not in ctx:
            return one
        c = bi.get((a, w), 0)
        return (c - cut(d2, c)) / sum(ctx[a]) + sum(cut(d2, x) for x in ctx[a]) / sum(ctx[a]) * one

    assert math.isclose(sum(p("<s>", w) for w in uni) + p("<s>", "never seen"), 1)
    return {i: (sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w)), sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), len(w), sum(x in uni for x in w)) for i, w in docs}, n


def test_matches_plain_counting(spark, odd, odd_rows):
    want, n = brute([(r[0], r[1]) for r in odd_rows])
    got = kn.score_documents(spark, odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        score, base, tokens, known = want[r["doc_id"]]
        assert math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_beats_the_base_on_held_out_text(spark):
    r = kn.score_documents(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").toPandas()
    assert r.score.sum() / r.n_tokens.sum() > r.base_score.sum() / r.n_tokens.sum() + 0.3


def test_no_rows_and_no_training(spark, none):
    assert kn.score_documents(spark, none).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = kn.score_documents(spark, spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_packing_round_trips():
    import numpy as np

    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (kn._unpack_sorted(kn._pack_sorted(x)) == x).all()
    assert kn.discounts([0, 0, 0, 0]) == [0.5, 1.0, 1.5]


def brute_order(rows, order):
    """doc_id -> score by plain counting of n-grams of any order."""
    docs = [(i, ["<s>", *(t or "").encode().lower().split(), None]) for i, t in rows]
    train = [w for i, w in docs if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {order: collections.Counter(tuple(w[j : j + order]) for w in train for j in range(len(w) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        counts[k].update(tuple(w[:k]) for w in train if 1 < k <= len(w))
    words = {x for w in train for x in w[1:]}
    follow = collections.defaultdict(list)
    for k in counts:
        for g, c in counts[k].items():
            follow[g[:-1]].append(c)
    d = {k: kn.discounts([sum(c == x for c in counts[k].values()) for x in (1, 2, 3, 4)]) for k in counts}
    cut = lambda k, c: d[k][min(c, 3) - 1] if c else 0
    stats = {h: (sum(x), sum(cut(len(h) + 1, c) for c in x)) for h, x in follow.items()}

    def p(h, w):
        lower = p(h[1:], w) if h else 1 / (len(words) + 1)
        if h not in stats:
            return lower
        c = counts[len(h) + 1].get((*h, w), 0)
        return (c - cut(len(h) + 1, c) + stats[h][1] * lower) / stats[h][0]

    for h in list(follow)[:: max(1, len(follow) // 20)]:
        assert math.isclose(sum(p(h, w) for w in words) + p(h, "never seen"), 1)
    return {i: sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w))) for i, w in docs}


def test_longer_orders_match_plain_counting(spark):
    import random

    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefgh") * (1 + r.randrange(2)) for _ in range(r.randrange(40)))) for i in range(60)] + [(60, "a"), (61, None), (62, "b never c"), (63, "a b c " * 400), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for order in (3, 4):
        want = brute_order(rows, order)
        got = kn.score_documents(spark, df, order=order).collect()
        assert len(got) == len(rows) and all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in got)


def test_the_query_looks_at_more_than_one_word(spark):
    from hornbeam.llm.queries import op5_kneser_ney

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_order(rows, 3)
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in op5_kneser_ney(spark, sf).collect())


def test_scoring_asks_for_each_word_once(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join("abcdefgh"[(i * j * j + j) % 8] for j in range(40))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) as text")
    meta = kn.train(spark, docs, f"file://{tmp_path}", 3)
    asked, counts = [], kn._counts
    monkeypatch.setattr(kn, "_counts", lambda path, meta, ids: asked.extend(ids.tolist()) or counts(path, meta, ids))
    kn.score(str(tmp_path), meta, [t.encode() for _, t in rows])
    assert len(asked) == len(set(asked)) == 9


def test_order_of_columns():
    import numpy as np

    g = np.random.default_rng(4)
    for highs in ((9, 9), (2**60, 9), (1, 2**32), (9, 2**40), (9, 9, 9), (50,)):
        columns = [g.integers(0, x, 500).astype(np.uint64) for x in highs]
        order = kn.gram_order(columns)
        assert sorted(order.tolist()) == list(range(500))
        assert list(zip(*(c[order].tolist() for c in columns))) == sorted(zip(*(c.tolist() for c in columns)))
    assert len(kn.gram_order([np.zeros(0, np.uint64)] * 2)) == 0
