"""Near duplicates by bottom-k sketches of one hash function.

Each text keeps the k smallest hashes of its shingle set. Runs of consecutive
retained values are the keys of inverted lists: two sets with a Jaccard index
of J have each value of the union's bottom k in common with probability J, so
at J = 0.8 and k = 64 the chance that they share no run of three is about 1e-10,
while texts that only share a passage rarely share a run. Within a list, all
members are compared with the list's first member by the union-sketch estimate;
lists whose members then lie in different families, the components of the near
pairs, compare the rest in blocks. Neither sends on more than joins families:
all members of a family are compared by the exact Jaccard index of their full
sets, many pairs at a time, and a spanning forest of the links is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_binary, stage_table
from .textops import U, Words, inside_one, mix, segmented_unique, text_slices, windows

#: Edges up to this number (16 bytes each) may be merged in the driver; beyond it the iterative join does it.
DRIVER_EDGES = 500_000
#: Largest number of list members in one block of comparisons.
LIST_BLOCK = 512
#: Largest number of sets in one block of verifications, and about how many bytes they have; a larger set is a block of its own.
VERIFY_BLOCK, VERIFY_BYTES = 1024, 16 << 20
#: A value is a column of a matrix product if one in so many pairs of a block share it; columns of a product, and pairs that are listed at a time.
DENSE, COLUMNS, LISTED = 256, 2048, 1 << 20
#: Bytes of text that a task turns into sets at a time.
SLICE = 1 << 20
#: Up to this number ids (16 bytes each) are broadcast to pick documents; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
_TOP = U(2**64 - 1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words has its whole sequence as its one shingle."""
    w = Words(texts, lower=True)
    at = inside_one(w.first, size)
    owner, value = segmented_unique(w.owner()[at], windows(w.hash, size)[at])
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(w.counts().tolist()):
        if 0 < n < size:
            whole = U(n)
            for h in w.hash[w.first[i] : w.first[i + 1]]:
                whole = mix(np.array([whole]) * U(0xD6E8FEB86659FD93) + h)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(value[cut[i] : cut[i + 1]])
    return out


def run_keys(sketch: np.ndarray, n: int) -> np.ndarray:
    """Keys of the inverted lists for a set of n values of which ``sketch`` holds the smallest.

    Sets of up to 5 values differ in at most one value when J >= 0.8, which may
    leave a common run of two only; any larger pair that is wholly retained has a
    common run of three by the pigeonhole principle.
    """
    if n < 4:
        return np.zeros(0, np.uint64)
    keys = [windows(sketch, 2)] if n <= 5 else []
    if n >= 5:
        keys.append(windows(sketch, 3) ^ U(0x5851F42D4C957F2D))
    return np.unique(np.concatenate(keys))


def union_common(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> tuple[int, int]:
    """Of two sketches, of sets of na and nb values, the common values and those of the union that are known.

    Up to the smaller of the largest retained values both sketches are complete,
    so the union's values up to there are known: at least its bottom k. Their
    ratio estimates the Jaccard index, and is it where both sets are retained.
    """
    top = min(a[-1] if na > len(a) else _TOP, b[-1] if nb > len(b) else _TOP)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common, max(1, np.searchsorted(a, top, "right") + np.searchsorted(b, top, "right") - common)


def _runs(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct values of several sets, where their runs begin in ``row`` and how long they are, and the sets they are in."""
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, row = value[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    at = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    return value[at], at, np.diff(at, append=len(value)), row


def shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all xs, in rows, with all ys; no set is empty.

    Values that many pairs share are columns of a product of 0-1 matrices, made
    in parts; pairs of the others are listed and counted.
    """
    out = np.zeros((len(xs), len(ys)), np.int32)
    ux, sx, mx, rx = _runs(xs)
    uy, sy, my, ry = (ux, sx, mx, rx) if ys is xs else _runs(ys)
    at = np.minimum(np.searchsorted(uy, ux), len(uy) - 1)
    i = np.flatnonzero(uy[at] == ux)
    j = at[i]
    sx, mx, sy, my = sx[i], mx[i], sy[j], my[j]
    pairs = mx * my
    dense = pairs * DENSE > out.size

    def ones(n: int, start: np.ndarray, m: np.ndarray, row: np.ndarray) -> np.ndarray:
        x = np.zeros((n, len(m)), np.float32)
        x[row[np.repeat(start - np.cumsum(m) + m, m) + np.arange(m.sum())], np.repeat(np.arange(len(m)), m)] = 1
        return x

    many = np.flatnonzero(dense)
    for lo in range(0, len(many), COLUMNS):
        c = many[lo : lo + COLUMNS]
        a = ones(len(xs), sx[c], mx[c], rx)
        out += (a @ (a if ys is xs else ones(len(ys), sy[c], my[c], ry)).T).astype(np.int32)
    few = np.flatnonzero(~dense)
    # A value stands for out.size / DENSE pairs at most, so a part has a bounded number of them.
    part = np.cumsum(pairs[few]) // LISTED
    for lo, hi in zip(*(np.searchsorted(part, np.unique(part), x) for x in ("left", "right"))):
        c = few[lo:hi]
        p, each = pairs[c], np.repeat(my[c], pairs[c])
        k = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        cell = rx[np.repeat(sx[c], p) + k // each] * len(ys) + ry[np.repeat(sy[c], p) + k % each]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def _forest(ok: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n places whose edges are the true cells of ``ok``, a matrix of places ``rows`` and ``cols``."""
    edge = np.zeros((n, n), bool)
    edge[np.ix_(rows, cols)] = ok
    edge |= edge.T
    left, a, b = np.ones(n, bool), [], []
    for root in np.flatnonzero(edge.any(1)).tolist():
        held = [root] if left[root] else []
        left[root] = False
        while held:
            x = held.pop()
            new = np.flatnonzero(edge[x] & left)
            left[new] = False
            a += [x] * len(new)
            b += new.tolist()
            held += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, independent of its order."""
    with np.errstate(over="ignore"):
        return tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (values, mix(values ^ U(0xA0761D6478BD642F))))


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n, f1, f2 (a 128-bit fingerprint of the set), sk (the k smallest hashes)."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, texts in text_slices(batch.column(1), SLICE):
                sets = shingle_sets(texts, size)
                prints = [fingerprint(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), *(pa.array([f[x] for f in prints], pa.int64()) for x in (0, 1)), pa.array([x[:k].tobytes() for x in sets], pa.binary())],
                    ["doc_id", "n", "f1", "f2", "sk"],
                )

    return docs.select("doc_id", as_binary("text").alias("text")).mapInArrow(work, "doc_id long, n long, f1 long, f2 long, sk binary")


def _keys(reps: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = [run_keys(np.frombuffer(s, np.uint64), n) for n, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if sum(map(len, keys)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in keys]))], ["key", "c"])

    return reps.filter("n >= 4").select("c", "n", "sk").mapInArrow(work, "key long, c long")


def _near(common, union, whole, least: float, percent: int):
    """Whether pairs may be links: by the exact index where both sketches are whole sets, else by the estimate."""
    return np.where(whole, 100 * common >= percent * union, common >= least * union)


def _estimated(pairs: DataFrame, reps: DataFrame, least: float, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sizes allow the index and whose estimate is near it."""
    side = lambda x: reps.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sk").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") >= F.greatest("na", "nb") * (percent / 100) - 1e-6)

    def work(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (3, 5))
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 4)]
            found = np.array([union_common(x, n, y, m) for x, n, y, m in zip(sides[0], na, sides[1], nb)], np.int64).reshape(-1, 2)
            whole = np.array([len(x) == n and len(y) == m for x, n, y, m in zip(sides[0], na, sides[1], nb)], bool)
            keep = _near(found[:, 0], found[:, 1], whole, least, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(work, "a long, b long")


def _by_group(batches, keys: list[str]):
    """Tables of the consecutive rows that agree on ``keys``."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in keys], 1)
        bounds = [0, *(np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1).tolist(), len(g)]
        for lo, hi in zip(bounds, bounds[1:]):
            now = tuple(g[lo].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def picked(docs: DataFrame, ids: DataFrame, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` joined left_semi or left_anti to ids (doc_id): without a shuffle of the texts while the ids, counted first, are few."""
    small = ids.limit(most + 1).count() <= most
    right = ids.select(F.col("doc_id").alias("picked_id"))
    return docs.join(F.broadcast(right) if small else right, docs["doc_id"] == right["picked_id"], how)


def _verified(spark: SparkSession, families: DataFrame, docs: DataFrame, reps: DataFrame, again: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of classes of one family that join all its members with 100 * intersection >= percent * union of the full sets.

    ``families`` has (c, component). A set travels once to its family; families
    of more than ``block`` members or VERIFY_BYTES are split into pairs of blocks.
    The sets are made of the texts of ``reps``; ids in ``again`` have several
    rows, of which one of each text is taken.
    """
    family = families.join(reps.select("c", "n"), "c")
    blocks = F.greatest(F.count("*") / F.lit(float(block)), F.sum("n") * 8 / F.lit(float(VERIFY_BYTES)))
    sizes = family.groupBy("component").agg(F.ceil(blocks).cast("int").alias("nb"))
    place = stage_table(spark, family.join(sizes, "component").select("c", "component", "nb", F.pmod(F.xxhash64("c"), "nb").cast("int").alias("mine")), "places")

    def sets(batches):
        for batch in batches:
            for i, j, texts in text_slices(batch.column(1), SLICE):
                made = shingle_sets(texts, size)
                prints = [fingerprint(x) for x in made]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array([f[x] for f in prints], pa.int64()) for x in (0, 1)), pa.array([x.tobytes() for x in made], pa.binary())], ["doc_id", "f1", "f2", "s"])

    where = reps.join(place.select("c"), "c", "left_semi").select("c", "doc_id", "f1", "f2")
    ids = where.select("doc_id").distinct()
    several = not again.isEmpty()
    given = picked(docs, ids.join(again, "doc_id", "left_anti") if several else ids, "left_semi").select("doc_id", as_binary("text").alias("text"))
    if several:
        given = given.union(picked(docs, ids.join(again, "doc_id", "left_semi"), "left_semi").select("doc_id", as_binary("text").alias("text")).distinct())
    full = given.mapInArrow(sets, "doc_id long, f1 long, f2 long, s binary").join(where, ["doc_id", "f1", "f2"]).select("c", "s")

    def work(batches):
        for t in _by_group(batches, ["component", "i", "j"]):
            ids, side = (t.column(x).to_numpy() for x in ("c", "side"))
            x, y = _sides(side)
            values = [np.frombuffer(v, np.uint64) for v in t.column("s").to_pylist()]
            n = np.array([len(v) for v in values])
            if not len(x) or not len(y):
                continue
            xs = [values[k] for k in x]
            common = shared(xs, xs if y is x else [values[k] for k in y]).astype(np.int64)
            ok = 100 * common >= percent * (n[x][:, None] + n[y] - common)
            if y is x:
                np.fill_diagonal(ok, False)
            a, b = _forest(ok, x, y, len(ids))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    rows = full.join(place.select("c", "component", *_block_pairs("nb")), "c")
    return rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").select("component", "i", "j", "side", "c", "s").mapInArrow(work, "a long, b long")


def _block_pairs(blocks: str) -> list[Column]:
    """Columns i, j and side of a member of block ``mine``: a row for each pair of blocks that it is in; side is 0 in a pair of a block with itself."""
    pair = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j"), F.when(F.col("mine") == x, 0).when(F.col("mine") < x, 1).otherwise(2).alias("side")))
    return [F.inline(pair)]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of both blocks; one array twice if a block is paired with itself."""
    if side[0] == 0:
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2)


def components(spark: SparkSession, edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(c, component) of every vertex of the edges (a, b): the smallest vertex reachable.

    Few edges are merged in the driver, their number having been counted; more
    alternate the large-star and small-star steps, whose edge count never grows
    and which need a logarithmic number of rounds, each a written table.
    """
    edges = edges.filter("a is not null and b is not null and a <> b")
    if edges.limit(driver_edges + 1).count() <= driver_edges:
        rows = edges.select("a", "b").toArrow()
        ends = np.stack([rows.column(x).to_numpy() for x in ("a", "b")]).astype(np.int64)
        ids, at = np.unique(ends, return_inverse=True)
        at, label = at.reshape(ends.shape), np.arange(len(ids))
        # Ends take the smaller label of their labels' places, labels that of their label, until none changes.
        while True:
            low = label[at].min(0)
            new = label.copy()
            for side in at:
                np.minimum.at(new, label[side], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == label).all():
                break
            label = new
        made = pa.table({"c": ids, "component": ids[label]})
        return spark.createDataFrame(made) if made.num_rows else spark.createDataFrame([], "c long, component long")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select("v", "u")) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before, e = None, stage_table(spark, edges.select("a", "b").distinct(), "edges")
    while before != (now := state(e)):
        before = now
        e = stage_table(spark, star(stage_table(spark, star(e, True), "large"), False), "small")
    ends = e.groupBy("a").agg(F.min("b").alias("b"))
    return ends.select(F.col("a").alias("c"), F.col("b").alias("component")).union(ends.select("b", "b").distinct())


def _open_pairs(members: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one list block (key, i, j) that join those families between which a pair passes the estimate."""

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, n, label, side = (t.column(x).to_numpy() for x in ("c", "n", "label", "side"))
        x, y = _sides(side)
        sk = [np.frombuffer(v, np.uint64) for v in t.column("sk").to_pylist()]
        if not len(x) or not len(y):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = np.array([len(v) == m for v, m in zip(sk, n)])
        top = np.array([_TOP if w else v[-1] for v, w in zip(sk, whole)], np.uint64)
        xs = [sk[k] for k in x]
        common = shared(xs, xs if y is x else [sk[k] for k in y])
        known = np.stack([np.searchsorted(sk[k], top[y], "right").astype(np.int32) for k in x])
        known += known.T if y is x else np.stack([np.searchsorted(sk[k], top[x], "right").astype(np.int32) for k in y]).T
        ok = _near(common, known - common, whole[x][:, None] & whole[y], least, percent)
        ok &= (np.minimum.outer(n[x], n[y]) >= np.maximum.outer(n[x], n[y]) * (percent / 100) - 1e-6) & (label[x][:, None] != label[y])
        a, b = _forest(ok, x, y, len(ids))
        return ids[a], ids[b]

    def work(batches):
        for t in _by_group(batches, ["key", "i", "j"]):
            a, b = compare(t)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    cols = ["key", "i", "j", "side", "c", "n", "label", "sk"]
    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select(*cols).mapInArrow(work, "a long, b long")


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, k: int = 64, percent: int = 80, slack: float = 0.25,
    driver_edges: int = DRIVER_EDGES, list_block: int = LIST_BLOCK, verify_block: int = VERIFY_BLOCK,
) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept: components of documents linked at ``percent`` Jaccard.

    Words are lower-cased in A-Z only. ``class_id`` is the smallest id with the
    same shingle set; classes, not copies, are compared. Null or wordless texts
    have an empty set, are linked with nothing and kept. Rows with a null id are
    kept with null class and component. Rows of one id are one document: each is
    returned, and the sets of all of its texts are linked. Other columns are
    ignored. An empty table gives an empty result. A very long text is shingled
    whole, with about 60 bytes of arrays a byte in its worker. Candidates are
    lost only if their estimate falls ``slack`` below the threshold or they
    share no run of retained values, at the threshold itself with a probability
    of about 4e-6 and 1e-10, and far less above it.
    """
    least = percent / 100 - slack
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_ = stage_table(spark, sketches(docs, shingle, k), "sketches")
    full = all_.filter("n > 0 and doc_id is not null")
    # A class is a set; its key is its place in the written table.
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.first("sk").alias("sk"))
    classes = stage_table(spark, classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    reps = classes.select("c", "doc_id", "n", "f1", "f2")
    sketched = classes.select("c", "n", "sk")
    own = F.struct("n", "f1", "f2")
    again = stage_table(spark, full.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(own).alias("lo"), F.max(own).alias("hi")).filter("rows > 1"), "again")
    # The sets of an id with several texts are linked through the first of them.
    torn = full.join(again.filter("lo <> hi"), "doc_id").select("doc_id", "n", "f1", "f2", "lo").distinct().join(classes.select("c", "n", "f1", "f2"), ["n", "f1", "f2"])
    first_of = classes.select(F.col("c").alias("a"), F.struct("n", "f1", "f2").alias("lo"))
    same = torn.join(first_of, "lo").select("a", F.col("c").alias("b"))
    keys = _keys(sketched)
    heads = keys.groupBy("key").agg(F.min("c").alias("head"), F.count("*").alias("size")).filter("size > 1")
    lists = stage_table(spark, keys.join(heads, "key"), "lists")
    star = lists.filter("c <> head").select(F.col("head").alias("a"), F.col("c").alias("b")).distinct()
    near = stage_table(spark, _estimated(star, sketched, least, percent), "near")
    labels = stage_table(spark, components(spark, near, driver_edges), "labels")

    # Lists whose members are in one family need no more; pairs with the head are done.
    held = lists.filter("size > 2").join(labels, "c", "left").withColumn("label", F.coalesce("component", "c"))
    open_ = held.filter("c <> head").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("left")).filter("lo <> hi")
    blocks = F.ceil(F.col("left") / F.lit(float(list_block))).cast("int")
    rest = held.filter("c <> head").select("key", "c", "label").join(open_.select("key", blocks.alias("blocks")), "key")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).select("key", "c", "label", *_block_pairs("blocks")).join(sketched, "c")
    near = near.union(stage_table(spark, _open_pairs(rest, least, percent).distinct(), "open"))
    families = stage_table(spark, components(spark, near, driver_edges), "families")
    # Near pairs of sets that are retained whole are links; only families with larger sets are left to verify.
    larger = families.join(sketched.filter(F.col("n") * 8 > F.octet_length("sk")).select("c"), "c", "left_semi").select("component").distinct()
    whole = near.join(families.join(larger, "component", "left_anti").select(F.col("c").alias("a")), "a", "left_semi").select("a", "b")
    links = _verified(spark, families.join(larger, "component", "left_semi"), docs, reps, again.select("doc_id"), shingle, percent, verify_block)
    final = stage_table(spark, components(spark, stage_table(spark, links.union(whole).union(same), "edges"), driver_edges), "components")
    least_of = final.join(reps.select("c", "doc_id"), "c").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = reps.join(final.join(least_of, "component"), "c", "left").select("n", "f1", "f2", F.col("doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))

    member = full.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    alone = all_.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return member.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
