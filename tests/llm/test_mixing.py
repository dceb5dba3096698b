import re
from collections import Counter, defaultdict

import pytest

from hornbeam.llm import mixing


def test_targets_reshare_the_excess():
    assert mixing.reshared_targets([10, 10, 80], [5, 2, 1]) == [30.0, 30.0, 40.0]
    sizes, weights = [100, 1, 50, 0, 3], [5, 2, 1, 5, 2]
    want = [0.0] * 5
    free, left = set(range(5)), float(sum(sizes))
    while free:  # the rounds as stated: share by weight, cap what is above, share the rest again
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > 3 * sizes[i]}
        for i in over or free:
            want[i] = 3.0 * sizes[i] if over else left * weights[i] / total
        left -= sum(want[i] for i in over)
        free = free - over if over else set()
    assert mixing.reshared_targets(sizes, weights) == pytest.approx(want)


def test_flow_of_overlapping_sources():
    # 10 words only in a, 10 only in b, 10 in both; quotas favour b.
    take = mixing.route([((0,), 10), ((1,), 10), ((0, 1), 10)], [10, 20])
    assert take == [{0: 10}, {1: 10}, {0: 0, 1: 10}]
    assert sum(sum(x.values()) for x in mixing.route([((0,), 10), ((0, 1), 10)], [15, 15])) == 30
    assert mixing.route([((0,), 10)], [100]) == [{0: 30}]
    assert mixing.route([], []) == []


def test_flow_is_optimal_on_small_cases():
    import itertools

    patterns, quotas, costs = [((0,), 2), ((0, 1), 3), ((1,), 1)], [5, 4], (0, 1, 3)
    best = None
    for x in itertools.product(*(range(3 * s + 1) for _, s in patterns)):
        for y in range(x[1] + 1):
            if x[0] + y <= quotas[0] and x[1] - y + x[2] <= quotas[1]:
                cost = sum(costs[k] * min(max(v - k * s, 0), s) for v, (_, s) in zip(x, patterns) for k in range(3))
                key = (-sum(x), cost)
                best = min(best, key) if best else key
    got = [sum(x.values()) for x in mixing.route(patterns, quotas, costs)]
    assert best == (-sum(got), sum(costs[k] * min(max(v - k * s, 0), s) for v, (_, s) in zip(got, patterns) for k in range(3)))


def test_mix_meets_targets(spark, odd, none, odd_rows):
    rows = mixing.mix_sources(spark, odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 0.5 for t, n in by.values())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_sources(spark, odd.repartition(2)).collect()), key=repr)
    assert mixing.mix_sources(spark, none).count() == 0


def cheapest(texts, quotas, most):
    """The least cost of repetitions that meets the quotas, over all ways to take whole words of each (text, source) cell."""
    import itertools

    cells = [(t, s, most * copies * size) for t, (size, by) in enumerate(texts) for s, copies in by.items()]
    best = None
    for x in itertools.product(*(range(cap + 1) for _, _, cap in cells)):
        got = Counter()
        each = Counter()
        for (t, s, _), n in zip(cells, x):
            got[s] += n
            each[t] += n
        if all(got[s] == q for s, q in quotas.items()):
            cost = 0
            for t, n in each.items():
                size = texts[t][0]
                levels = [r * (r + 1) // 2 for r in range(most)]
                for c in levels:
                    cost += c * min(n, size)
                    n -= min(n, size)
                cost += (2 * levels[-1] + 1) * n
            best = cost if best is None else min(best, cost)
    return best


def test_shared_texts_are_repeated_least(spark):
    """The flow's cost of repetitions equals the least of all mixes, texts being shared by sources."""
    docs = [(1, "p q", "a"), (2, "r", "a"), (3, "p q", "b"), (4, "u v", "b"), (5, "w", "c")]
    got = mixing.mix_sources(spark, spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    quotas = {r["source"]: round(r["target"]) for r in got}
    texts: dict = defaultdict(lambda: [0, Counter()])
    for _, t, s in docs:
        texts[t][0] = len(t.split())
        texts[t][1][s] += 1
    taken: Counter = Counter()
    for r in got:
        taken[docs[r["doc_id"] - 1][1]] += r["taken"]
    levels = (0, 1, 3)
    cost = 0
    for t, n in taken.items():
        size = texts[t][0]
        for c in levels:
            cost += c * min(n, size)
            n -= min(n, size)
        cost += 7 * n
    assert cost == cheapest([tuple(x) for x in texts.values()], quotas, 3)
    by = Counter()
    for r in got:
        by[r["source"]] += r["taken"]
    assert by == Counter(quotas)


def test_mix_of_the_whole_table(spark):
    """Targets as stated, met by every source on the driver's documents, with texts that sources share among them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len(re.findall("[^ \t\n\x0b\x0c\r]+", r["text"] or "")) for i, r in rows.items()}
    sources = sorted({r["source"] for r in rows.values()})
    total = Counter()
    for i, r in rows.items():
        total[r["source"]] += size[i]
    want = dict(zip(sources, mixing.reshared_targets([total[s] for s in sources], [(5, 2, 1)[k % 3] for k in range(len(sources))])))
    got = mixing.mix_sources(spark, docs).collect()
    again = mixing.mix_sources(spark, docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    by = Counter()
    for r in got:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[r["source"]]) and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    assert all(by[s] == round(want[s]) for s in sources)
    holders = defaultdict(set)
    for r in rows.values():
        holders[r["text"]].add(r["source"])
    assert any(len(x) > 1 for x in holders.values())
