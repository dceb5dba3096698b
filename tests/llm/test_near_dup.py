import random
import re

import pytest

from hornbeam.llm.near_dup import components, near_duplicates, run_keys


def shingled(text, size=2):
    w = re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size=2, percent=80):
    """Component of each row by comparing all pairs; rows of one id are one vertex, null ids none."""
    sets = [(i, shingled(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], None
    for i in range(n):
        if base is None or r.random() < 0.25:
            base = [r.choice(words) for _ in range(r.choice([3, 5, 6, 12, 60, 200]))]
        text = list(base)
        for _ in range(r.randrange(0, 1 + len(text) // 8)):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"driver_edges": 0, "list_block": 4, "verify_block": 4}])
def test_matches_all_pairs(spark, limits):
    rows = corpus(300, 5)
    r = random.Random(1)
    r.shuffle(rows)
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **limits).collect()
    want = brute(rows)
    assert {x["doc_id"]: x["component_id"] for x in got} == want and all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert len(set(want.values())) < 250


def test_small_sets_share_a_run():
    import itertools

    import numpy as np

    values = np.sort(np.random.default_rng(0).integers(0, 2**63, 15).astype(np.uint64))
    for n in range(5, 16):
        union = values[:n]
        for gone in itertools.combinations(range(n), n // 5):
            for split in range(len(gone) + 1):
                a = np.delete(union, list(gone[:split]))
                b = np.delete(union, list(gone[split:]))
                assert np.isin(run_keys(a, len(a)), run_keys(b, len(b))).any()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    for limit in (0, 1000):
        got = {r["c"]: r["component"] for r in components(spark, edges, limit).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_odd_rows(spark, odd, none, odd_rows):
    got = near_duplicates(spark, odd).collect()
    assert len(got) == len(odd_rows)
    want = brute([(r[0], r[1]) for r in odd_rows])
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: r["n_shingles"] for r in got}[3] == 1
    assert near_duplicates(spark, none).count() == 0


def test_ids_with_several_texts_link_all_their_neighbours(spark):
    r = random.Random(3)
    a, b = ([f"{x}{r.randrange(900)}" for _ in range(60)] for x in "ab")
    near = lambda w: " ".join([*w[:-2], "other", "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "something else"), (1, " ".join(a)), (None, near(a)), (5, near(b).upper())]
    # One id with many texts, and many rows of one text under one id.
    rows += [(50, " ".join([*a[:30], str(i), *b[:30]])) for i in range(20)] + [(60, " ".join([*a[:29], "x", "7", *b[:30]]))] * 20
    r.shuffle(rows)
    for limits in ({}, {"driver_edges": 0, "list_block": 4, "verify_block": 4}):
        got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **limits).collect()
        want = brute(rows)
        assert want[3] == want[2] == want[5] == 1 and len(got) == len(rows)
        assert all(x["component_id"] == want.get(x["doc_id"]) for x in got)
        assert {x["doc_id"]: x["kept"] for x in got} == {i: i is None or want[i] == i for i, _ in rows}


def test_pairs_of_alike_texts_are_not_listed(spark, monkeypatch):
    """A family of texts that are alike, most of them below the threshold, writes rows in proportion to its members."""
    from hornbeam.llm import near_dup

    r = random.Random(7)
    base = [f"w{r.randrange(900)}" for _ in range(300)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(r.randrange(6, 20)):
            text[r.randrange(len(text))] = f"x{r.randrange(900)}"
        rows.append((i, " ".join(text)))
    written = {}

    def counted(s, df, tag):
        out = stage(s, df, tag)
        written[tag] = written.get(tag, 0) + out.count()
        return out

    stage = near_dup.stage_table
    monkeypatch.setattr(near_dup, "stage_table", counted)
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), list_block=32, verify_block=32).collect()}
    want = brute(rows)
    assert got == want and 2 < len(set(want.values())) < 160
    assert written["open"] + written["edges"] < 8 * len(rows), written


def test_intersections_of_many_sets(monkeypatch):
    import numpy as np

    from hornbeam.llm import near_dup

    g = np.random.default_rng(2)
    sets = [np.unique(g.integers(0, most, n).astype(np.uint64)) for n, most in zip(g.integers(1, 80, 60), [40, 400, 4000] * 20)]
    for dense in (1, 60, 10**9):
        monkeypatch.setattr(near_dup, "DENSE", dense)
        monkeypatch.setattr(near_dup, "COLUMNS", 7)
        monkeypatch.setattr(near_dup, "LISTED", 50)
        for xs, ys in ((sets, sets), (sets[:20], sets[20:]), (sets[:1], sets[1:2])):
            want = [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
            assert (near_dup.shared(xs, ys) == want).all()
