"""Mixing overlapping sources to target weights by min-cost flow.

Texts are aggregated by membership pattern, the set of sources that hold them;
words flow from patterns, at a cost that rises with each repetition of a text,
to the quotas of the sources; then documents of each pattern and source are
taken in a seeded order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, small, stage_table

#: Patterns and sources are planned in the driver; more than these are refused.
MAX_PATTERNS = 100_000
BUCKETS_HEX = 3


def reshared_targets(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of all sizes by weight, none above ``most`` times its size: the excess is reshared until none is above.

    Sharing by weight and capping what is above ends at min(cap, rate * weight)
    for one rate, found by going through the caps in order of cap / weight.
    """
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        rate = left / weight
        if rate <= caps[i] / weights[i]:
            for j in order[k:]:
                out[j] = rate * weights[j]
            return out
        out[i] = float(caps[i])
        left, weight = left - caps[i], weight - weights[i]
    return out


def route(
    patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...] = (0, 1, 3), rooms: list[tuple[int, ...]] | None = None,
) -> list[dict[int, int]]:
    """Of each pattern (its sources, its size), the words to send to each source so that quotas are met as far as can be, at least cost.

    Successive shortest paths with potentials. Repetition r of a pattern is an
    arc of its size and cost ``costs[r]``; convex costs fill them in order.
    ``rooms`` bounds what each source can take of a pattern, in its sources'
    order, and lets texts be repeated beyond ``costs``, at the last one's double.
    """
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(u: int, v: int, cap: int, c: int) -> None:
        for a, b, k, x in ((u, v, cap, c), (v, u, 0, -c)):
            head[a].append(len(to))
            to.append(b)
            room.append(k)
            cost.append(x)

    for p, (members, size) in enumerate(patterns):
        for c in costs:
            arc(source, p, size, c)
        if rooms:
            arc(source, p, sum(rooms[p]), 2 * costs[-1] + 1)
        for i, s in enumerate(members):
            arc(p, n + s, rooms[p][i] if rooms else len(costs) * size, 0)
    for s, q in enumerate(quotas):
        arc(n + s, sink, q, 0)
    price = [0] * (n + m + 2)
    while True:
        dist: list[float] = [float("inf")] * (n + m + 2)
        via = [-1] * (n + m + 2)
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in head[u]:
                if room[e] and d + cost[e] + price[u] - price[to[e]] < dist[to[e]]:
                    dist[to[e]] = d + cost[e] + price[u] - price[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (int(dist[to[e]]), to[e]))
        if via[sink] < 0:
            break
        for v, d in enumerate(dist):
            price[v] += int(min(d, dist[sink]))
        path, u = [], sink
        while u != source:
            path.append(via[u])
            u = to[via[u] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
        # More paths of this length, depth first over arcs of reduced cost 0; what this misses the next round finds.
        dead: set[int] = set()
        at = [0] * len(head)
        while True:
            path, u, on = [], source, {source}
            while u != sink:
                while at[u] < len(head[u]):
                    e = head[u][at[u]]
                    if room[e] and to[e] not in dead and to[e] not in on and cost[e] + price[u] == price[to[e]]:
                        break
                    at[u] += 1
                else:
                    if not path:
                        break
                    dead.add(u)
                    on.discard(u)
                    u = to[path.pop() ^ 1]
                    continue
                path.append(e)
                u = to[e]
                on.add(u)
            if not path:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow
    return [{to[e] - n: room[e ^ 1] for e in head[p] if n <= to[e] < source} for p in range(n)]


def _taken(rows: DataFrame, keys: list[str], plan: DataFrame, seed: str) -> DataFrame:
    """Adds ``taken`` to rows of (doc_id, size, h, keys), given the copies of each document of a key and the words left over.

    What is left is taken in the order of md5(seed:doc_id), the last document in
    part; rows without an id are ordered by their text's hash. Running sums are
    kept by key and the first hex digits, so that no task holds a whole key.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("h").cast("string")))
    rows = rows.withColumn("rank_key", F.md5(F.concat_ws(":", F.lit(seed), ident))).withColumn("bucket", F.substring("rank_key", 1, BUCKETS_HEX))
    offsets = rows.groupBy(*keys, "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = offsets.withColumn("before", F.sum("bucket_size").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("bucket_size"))
    offsets = offsets.join(F.broadcast(plan), keys).select(*keys, "bucket", "before", "copies", "rest")
    inner = W.partitionBy(*keys, "bucket").orderBy("rank_key", "doc_id", "h", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inner)).join(offsets, [*keys, "bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("upto") + F.col("size")))
    return rows.withColumn("taken", F.col("copies") * F.col("size") + extra).drop("rank_key", "bucket", "before", "copies", "rest", "upto")


def _planned(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} {what}")
    return rows


def _tag(c):
    """A source's name as a key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("~"))


def _name(tag: str) -> str | None:
    return None if tag == "~" else tag[1:]


def mix_patterns(spark: SparkSession, sized: DataFrame, quotas: dict[str | None, int], seed: str = "mix", costs: tuple[int, ...] = (0, 1, 3)) -> DataFrame:
    """Adds ``taken`` to rows of (doc_id, size, members: array of source names), each document being of several sources itself.

    Each document of a pattern is repeated as often as the flow through the
    pattern allows all of them; what is left is taken in a seeded order. Only
    pattern totals (at most MAX_PATTERNS rows) reach the driver.
    """
    names = sorted(quotas, key=lambda x: (x is None, x or ""))
    index = {x: i for i, x in enumerate(names)}
    sized = sized.withColumn("pattern", F.array_sort(F.array_distinct(F.transform("members", _tag)))).withColumn("h", F.lit(0))
    totals = _planned(sized.groupBy("pattern").agg(F.sum("size").alias("size")), "membership patterns")
    totals = sorted(((tuple(r["pattern"]), int(r["size"])) for r in totals), key=lambda x: x[0])
    of = lambda pattern: tuple(sorted(index[_name(x)] for x in pattern if _name(x) in index))
    take = route([(of(p), size) for p, size in totals], [quotas[x] for x in names], costs)
    plan = [(list(p), *(divmod(sum(x.values()), size) if size else (0, 0))) for (p, size), x in zip(totals, take)]
    plan = spark.createDataFrame(plan, "pattern array<string>, copies long, rest long")
    return _taken(sized, ["pattern"], plan, seed).drop("pattern", "h")


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row for each row of ``docs``.

    Sources, by code point and null last, weigh ``weights`` in turn. Sizes are
    words; a null text has none. Sources overlap in the texts that several of
    them hold: repeating a text costs alike in whichever source, so the flow
    prefers texts that nothing else takes. Each source's taken words sum to its
    target, rounded; no document exceeds ``most`` times its size. Repeated rows
    are documents as often as they come; a null id ranks by its text's hash. An
    empty table gives an empty result; other columns are ignored; very long
    texts are counted and hashed whole.
    """
    text = F.col(text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    sized = stage_table(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), _tag(source).alias("tag"), size.alias("size"), F.xxhash64(text).alias("h")), "sizes")
    found = sorted(_planned(sized.groupBy("source").agg(F.sum("size").alias("size")), "sources"), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    targets = reshared_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)

    texts = stage_table(spark, sized.filter("size > 0").groupBy("h").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"), F.max("size").alias("size")), "texts")
    held = sized.join(small(texts.filter("lo <> hi").select("h")), "h", "left_semi")
    shared = stage_table(spark, held.groupBy("h").agg(F.array_sort(F.collect_set("tag")).alias("pattern"), F.max("size").alias("size")), "shared")
    rows = stage_table(spark, sized.join(small(shared.select("h", "pattern")), "h", "left").withColumn("pattern", F.coalesce("pattern", F.array("tag"))), "patterns")
    once = texts.filter("lo = hi").select(F.array("lo").alias("pattern"), "size").union(shared.select("pattern", "size")).groupBy("pattern").agg(F.sum("size").alias("size"))
    once = {tuple(r["pattern"]): int(r["size"]) for r in _planned(once, "membership patterns")}
    parts = {(tuple(r["pattern"]), r["tag"]): int(r["size"]) for r in _planned(rows.groupBy("pattern", "tag").agg(F.sum("size").alias("size")), "patterns and sources")}

    place = {("~" if r["source"] is None else "s" + r["source"]): i for i, r in enumerate(found)}
    patterns = sorted(once)
    members = [tuple(sorted(p, key=place.get)) for p in patterns]
    flow = route(
        [(tuple(place[t] for t in m), once[p]) for p, m in zip(patterns, members)], [round(t) for t in targets], tuple(r * (r + 1) // 2 for r in range(most)), [tuple(most * parts[p, t] for t in m) for p, m in zip(patterns, members)]
    )
    plan = {(p, t): divmod(x[place[t]], parts[p, t]) for p, m, x in zip(patterns, members, flow) for t in m if parts[p, t]}
    plan = spark.createDataFrame([(list(p), t, *plan.get((p, t), (0, 0))) for p, t in parts], "pattern array<string>, tag string, copies long, rest long")
    mixed = _taken(rows, ["pattern", "tag"], plan, seed)
    facts = spark.createDataFrame([(r["source"], s, t) for r, s, t in zip(found, sizes, targets)], "name string, source_size long, target double")
    return mixed.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source", "size", "source_size", "target", "taken")
