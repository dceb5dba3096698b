from collections import defaultdict

from hornbeam.llm.line_dedup import remove_boilerplate


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for ident, text, site in rows:
        for n, line in enumerate((text or "").split("\n")):
            t = line.strip(" \t\n\x0b\x0c\r")
            if t:
                sites[t].add(site)
                key = (ident is not None, ident or 0, n)
                first[t] = min(first.get(t, key), key)
    out = []
    for ident, text, _ in rows:
        kept = [line for n, line in enumerate((text or "").split("\n")) if not (len(sites[t := line.strip(" \t\n\x0b\x0c\r")]) >= least and t and first[t] != (ident is not None, ident or 0, n))]
        out.append((ident, None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rows = [(i, "\n".join(["cookie notice ", f"own line {i}", "menu" if i % 2 else "  menu", "shared by few" if i < 3 else "x", "dup", "dup"]), f"site{i % 7}" if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = remove_boilerplate(spark, df, min_sites=5)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == brute(rows, 5)
    assert got.agg({"n_removed": "sum"}).first()[0] > 100


def test_odd_rows(spark, odd, none, odd_rows):
    got = remove_boilerplate(spark, odd, min_sites=2)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == brute([(r[0], r[1], r[3]) for r in odd_rows], 2)
    assert remove_boilerplate(spark, none).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    for shared in (None, 7):
        rows = [(100 + i, "menu\nown", f"s{i}") for i in range(5)] + [(1, "menu", "s9"), (shared, "menu\nfirst body", "s1"), (shared, "clean line\nmenu of ours", "s2"), (shared, "clean line\nmenu", "s3")]
        got = remove_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), min_sites=3).collect()
        left = sorted(r["text"] for r in got if r["doc_id"] == shared)
        first = "menu\nfirst body" if shared is None else "first body"
        assert left == sorted([first, "clean line\nmenu of ours", "clean line"])
    rows = [(None, f"menu\nbody {i}", f"s{i}") for i in range(6)]
    got = remove_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=3).collect()
    assert sum("menu" in r["text"] for r in got) == 1 and {r["text"][-6:] for r in got} == {f"body {i}" for i in range(6)}
