"""An interpolated modified Kneser-Ney model of any order from 2, counted by Spark.

Words are 64-bit hashes; their rank among all training hashes is their id.
Tasks count locally and exchange packed, sorted arrays by hash bucket, so a
frequent word or n-gram is one entry a task. Reducers write each bucket as
sorted arrays into the shared folder, where scoring workers map them into
memory and look up sorted batches.

An n-gram of three words and more goes to the bucket of its middle, all but its
first and last word: there the reducer sees all that follows each context, and
all words that the shorter n-gram follows, whose number is the count one order
down. Middles of frequent words are salted by the first word, so that no bucket
is hot; their shorter n-grams are summed in one more exchange.
"""

from __future__ import annotations

import functools
import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_binary, local_path, new_folder, stage_table
from .near_dup import _by_group
from .textops import U, Words, mix, text_slices

END = U(0xE7037ED1A0B428DB)
#: Bytes of text a bucket stands for, up to so many buckets; beyond, a bucket stands for the larger number, so that tasks don't send ever smaller rows.
BUCKET_BYTES, LEAST_BUCKETS, MANY_BUCKETS, LARGE_BUCKET_BYTES = 12 << 20, 8, 1 << 16, 96 << 20
#: A word that came more often than this share of a bucket's tokens is split over several buckets.
HOT_SHARE = 1 / 8
#: Distinct keys a task holds before it sends them on.
HELD = 3_000_000
#: A context of so many lookups in a batch is searched on its own.
OFTEN = 12
_PACKED = "kind int, bucket int, keys binary, counts binary"


def pack(x: np.ndarray) -> bytes:
    """Sorted or small integers as transposed bytes, compressed, after their number of bytes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(_codec().decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


@functools.lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", 3)


def _pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=U(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[at], *(np.add.reduceat(c[order], at) for c in counts))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if x.max(initial=0) < 1 << 32 else x


def _save(path: str, x: np.ndarray) -> None:
    """Whole or not at all; attempts of the same task write the same bytes."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, x)
    os.replace(part, path)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ending with END; the first token of each text, and whether a token is a text's first."""
    w = Words(texts, lower=True)
    n = w.counts()
    first = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.empty(first[-1], np.uint64)
    last = np.zeros(len(out), bool)
    last[first[1:] - 1] = True
    out[last] = END
    out[~last] = w.hash
    opens = np.zeros(len(out), bool)
    opens[first[:-1]] = True
    return out, first, opens


def parts(values: np.ndarray):
    """(value, first place, place after the last) of each run of sorted values."""
    if len(values):
        at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        yield from zip(values[at].tolist(), at.tolist(), np.append(at[1:], len(values)).tolist())


def parts_of(values: np.ndarray, least: int):
    """As ``parts``, only runs of ``least`` values at least."""
    if len(values):
        at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        end = np.append(at[1:], len(values))
        long = end - at >= least
        yield from zip(values[at[long]].tolist(), at[long].tolist(), end[long].tolist())


_KINDS = (pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS)], ["kind", "bucket", "keys", "counts"])


class _Counter:
    """Counts of word hashes in a task, sent on by bucket when many are held."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.size = bits, [], 0

    def add(self, keys: np.ndarray):
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c))
        self.size += len(k)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self):
        if not self.parts:
            return
        keys, counts = summed(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        self.parts, self.size = [], 0
        # Sorted hashes are sorted by bucket, too.
        yield _batch([(1, b, _pack_sorted(keys[i:j]), pack(counts[i:j].astype(np.uint32))) for b, i, j in parts((keys >> U(64 - self.bits)).astype(np.int64))])


def gram_columns(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The ids of n-grams, two to a 64-bit column: the middle, then the first and the last word."""
    ids = [x.astype(np.uint64) for x in [*ids[1:-1], ids[0], ids[-1]]]
    return [(ids[j] << U(32)) | ids[j + 1] if j + 1 < len(ids) else ids[j] for j in range(0, len(ids), 2)]


def gram_ids(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    halves = [h for x in columns for h in (x >> U(32), x & U(0xFFFFFFFF))]
    halves = halves[:k] if k % 2 == 0 else [*halves[: k - 1], columns[-1]]
    return [halves[k - 2], *halves[: k - 2], halves[k - 1]]


def gram_hash(ids: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        h = mix(h * U(0xD6E8FEB86659FD93) + x.astype(np.uint64) + U(1))
    return h


def gram_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns: that of the first, in which runs of equal values are put in order by a last one of 32 bits."""
    if len(columns) > 2 or len(columns) == 2 and columns[1].max(initial=0) >> U(32):
        return np.lexsort(columns[::-1])
    order = np.argsort(columns[0])
    if len(columns) == 2:
        value = columns[0][order]
        new = np.concatenate(([True], value[1:] != value[:-1]))
        run = np.flatnonzero(~(new & np.append(new[1:], True)))
        order[run] = order[run][np.argsort((np.cumsum(new)[run].astype(np.uint64) << U(32)) | columns[1][order[run]])]
    return order


def by_bucket(bucket: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of buckets, of a narrow type if they fit it, which is sorted by radix."""
    return np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")


def summed_grams(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams in order with the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = gram_order(columns)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def gram_core(ids: list[np.ndarray]) -> list[np.ndarray]:
    """The middle of an n-gram; of a pair, the first word."""
    return ids[:1] if len(ids) == 2 else ids[1:-1]


def gram_buckets(path: str, meta: dict, ids: list[np.ndarray], splits: np.ndarray | None = None) -> np.ndarray:
    """Of each n-gram the bucket of its middle, salted by the first word; of a pair, that of the first word, salted by the second. splits: the least of the middle's, if known."""
    core, salt = gram_core(ids), ids[1] if len(ids) == 2 else ids[0]
    if splits is None:
        splits = np.minimum.reduce([_splits(path, meta, x) for x in core])
    h = gram_hash(core)
    hot = np.flatnonzero(splits > 1)
    h[hot] = mix(h[hot] + U(1) + gram_hash([salt[hot]]) % splits[hot].astype(np.uint64))
    return (h >> U(64 - meta["bits"])).astype(np.int64)


def gram_rows(path: str, meta: dict, columns: list[np.ndarray], counts: np.ndarray, k: int):
    """Batches of sorted distinct n-grams by bucket."""
    if not len(counts):
        return
    bucket = gram_buckets(path, meta, gram_ids(columns, k))
    order = by_bucket(bucket, meta["bits"])
    rows = []
    for b, lo, hi in parts(bucket[order]):
        i = order[lo:hi]
        keys = pack(np.concatenate([np.diff(columns[0][i], prepend=U(0)), *(c[i] for c in columns[1:])]))
        rows.append((k, b, keys, pack(counts[i].astype(np.uint32))))
    yield _batch(rows)


def gathered_grams(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    parts, counts = [], []
    for keys, c in zip(t.column("keys").to_pylist(), t.column("counts").to_pylist()):
        counts.append(unpack(c, np.uint32).astype(np.int64))
        columns = unpack(keys, np.uint64).reshape(-1, len(counts[-1]))
        parts.append([np.cumsum(columns[0], dtype=np.uint64), *columns[1:]])
    return summed_grams([np.concatenate(x) for x in zip(*parts)], np.concatenate(counts))


class _GramCounter:
    """Counts of n-grams in a task, sent on by bucket when many are held."""

    def __init__(self, path: str, meta: dict, k: int):
        self.path, self.meta, self.k, self.parts, self.size = path, meta, k, [], 0

    def add(self, ids: list[np.ndarray]):
        columns, counts = summed_grams(gram_columns(ids), np.ones(len(ids[0]), np.int64))
        self.parts.append((columns, counts))
        self.size += len(counts) * len(columns)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self):
        if self.parts:
            columns, counts = summed_grams([np.concatenate(x) for x in zip(*(p for p, _ in self.parts))], np.concatenate([c for _, c in self.parts]))
            self.parts, self.size = [], 0
            yield from gram_rows(self.path, self.meta, columns, counts, self.k)


def grams_before(ids: np.ndarray, first: np.ndarray, begin: int, n: int) -> list[np.ndarray]:
    """Of every token the ids of the ``n`` tokens before it, the farthest first; -2 beyond the begin mark."""
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for j in range(n, 0, -1):
        x = np.full(len(ids), -2, np.int64)
        x[j:] = ids[:-j]
        x[place < j] = -2
        x[place == j - 1] = begin
        out.append(x)
    return out


def _save_followers(path: str, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> None:
    """One file of all that follows the contexts of a bucket, given in order of (context, word).

    A context that came once is its hash and word. Of the others, counts are
    single bytes, 255 standing for a value in a list of larger ones.
    """
    at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    size = np.diff(at, append=len(context))
    total, one, two = (np.add.reduceat(x.astype(np.int64), at) for x in (count, count == 1, count == 2))
    single = total == 1
    many = np.repeat(~single, size)
    numbers = np.concatenate([total[~single], one[~single], two[~single], count[many]])
    large = np.flatnonzero(numbers >= 255)
    start = np.concatenate(([0], np.cumsum(size[~single])))
    arrays = [context[at[single]], context[at[~single]], numbers[large].astype(np.uint64), word[at[single]].astype(np.uint32), start.astype(np.uint32), word[many].astype(np.uint32), large.astype(np.uint32), np.minimum(numbers, 255).astype(np.uint8)]
    _save(path, np.concatenate([np.array([len(x) for x in arrays], np.uint64).view(np.uint8), *(np.ascontiguousarray(x).view(np.uint8) for x in arrays)]))


@functools.lru_cache(maxsize=1 << 14)
def _followers(path: str) -> tuple[np.ndarray, ...]:
    raw = np.load(path, mmap_mode="r").view(np.ndarray)
    at, out = 64, []
    for n, kind in zip(raw[:64].view(np.uint64).tolist(), (np.uint64,) * 3 + (np.uint32,) * 4 + (np.uint8,)):
        end = at + n * np.dtype(kind).itemsize
        out.append(raw[at:end].view(kind))
        at = end
    return tuple(out)


def _numbers(held: tuple[np.ndarray, ...], at: np.ndarray) -> np.ndarray:
    value, place, small = held[2], held[6], held[7]
    out = small[at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = value[np.searchsorted(place, at[large])]
    return out


def _at(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted keys in a sorted array, and whether they are there."""
    if not len(held):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return at, held[at] == keys


def _looked_up(path: str, tag: str, bits: int, bucket: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Columns total, followers once, twice and more of each context, and the count of the word after it; word is -1 if unknown."""
    # By bucket, then about by context, in one key; searches need no more.
    low = context if context.max(initial=0) < 1 << (64 - bits) else context >> U(bits)
    order = np.argsort((bucket.astype(np.uint64) << U(64 - bits)) | low)
    context, word = context[order], word[order]
    sorted_ = np.zeros((5, len(order)), np.int64)
    for b, first, last in parts(bucket[order]):
        name = f"{path}/{tag}-{b:07d}.npy"
        if not _exists(name):
            continue
        held, keys, asked, out = _followers(name), context[first:last], word[first:last], sorted_[:, first:last]
        at, there = _at(held[0], keys)
        out[0] = out[1] = there
        out[4, there] = held[3][at[there]] == asked[there]
        i = np.flatnonzero(~there)
        at, there = _at(held[1], keys[i])
        i, at, n = i[there], at[there], len(held[1])
        total, one, two = (_numbers(held, at + x * n) for x in range(3))
        start, end = held[4][at].astype(np.int64), held[4][at + 1].astype(np.int64)
        for row, x in enumerate((total, one, two, end - start - one - two)):
            out[row, i] = x
        low, high, want = start.copy(), end - 1, asked[i]
        # A context that is asked often has its words searched at once, the others step by step together.
        for _, x, y in parts_of(at, OFTEN):
            lo, hi = int(start[x]), int(end[x])
            low[x:y] = high[x:y] = lo + np.minimum(np.searchsorted(held[5][lo:hi], want[x:y].astype(np.uint32)), hi - lo - 1)
        left = np.flatnonzero(low < high)
        while len(left):
            x, y = low[left], high[left]
            middle = (x + y) >> 1
            less = held[5][middle] < want[left]
            low[left], high[left] = np.where(less, middle + 1, x), np.where(less, y, middle)
            left = left[low[left] < high[left]]
        found = held[5][low] == want if len(i) else np.zeros(0, bool)
        out[4, i[found]] = _numbers(held, 3 * n + low[found])
    out = np.empty_like(sorted_)
    out[:, order] = sorted_
    return out


@functools.lru_cache(maxsize=1 << 14)
def _mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r").view(np.ndarray)


def _ids(folder: str, meta: dict, hashes: np.ndarray) -> np.ndarray:
    """The ids of sorted distinct hashes; -1 for unknown words."""
    out = np.full(len(hashes), -1, np.int64)
    for b, lo, hi in parts((hashes >> U(64 - meta["bits"])).astype(np.int64)):
        first = meta["offset"][b]
        if meta["offset"][b + 1] > first:
            known = _mapped(f"{folder}/v{b:07d}.npy")
            at = np.minimum(np.searchsorted(known, hashes[lo:hi]), len(known) - 1)
            out[lo:hi] = np.where(known[at] == hashes[lo:hi], first + at, -1)
    return out


def _counts(path: str, meta: dict, ids: np.ndarray) -> np.ndarray:
    """How often words, given by sorted distinct ids, came in training."""
    out = np.zeros(len(ids), np.int64)
    for b, lo, hi in parts(np.searchsorted(meta["offset"], ids, "right") - 1):
        out[lo:hi] = _mapped(f"{path}/n{b:07d}.npy")[ids[lo:hi] - meta["offset"][b]]
    return out


def _splits(path: str, meta: dict, ids: np.ndarray) -> np.ndarray:
    """Over how many buckets the n-grams around each word are split: the begin mark's over all, those of words unknown or rare are not."""
    ids = ids.astype(np.int64)
    if len(ids) and (ids[1:] >= ids[:-1]).all():
        new = np.concatenate(([True], ids[1:] != ids[:-1]))
        distinct, back = ids[new], np.cumsum(new) - 1
    else:
        distinct, back = np.unique(ids, return_inverse=True)
    out = np.ones(len(distinct), np.int64)
    known = (distinct >= 0) & (distinct < meta["words"])
    out[known] = -(-_counts(path, meta, distinct[known]) // meta["hot"])
    out[distinct == meta["words"]] = 1 << meta["bits"]
    return out[back]


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of keys counted once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def _discount(d: list[float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def train(spark: SparkSession, docs: DataFrame, folder: str, order: int = 2) -> dict:
    """Counts (doc_id, text binary) and writes the model's arrays into ``folder``; returns what scoring needs besides them.

    Only totals by bucket come to the driver. Words of a text are preceded by a
    begin mark, whose id is the vocabulary size, and followed by END. Below the
    highest order an n-gram's count is the number of words it follows, but its
    occurrences if it starts with the begin mark, which follows nothing.
    """
    if order < 2:
        raise ValueError("order is 2 at least")
    path = local_path(folder)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(min(size / BUCKET_BYTES, max(MANY_BUCKETS, size / LARGE_BUCKET_BYTES)), LEAST_BUCKETS)
    bits = int(np.ceil(np.log2(buckets)))

    def words(batches):
        held = _Counter(bits)
        for batch in batches:
            for i, j, texts in text_slices(batch.column(0)):
                yield from held.add(tokens(texts)[0])
        yield from held.flush()

    def merge_words(batches):
        os.makedirs(path, exist_ok=True)
        for t in _by_group(batches, ["bucket"]):
            keys, counts = summed(np.concatenate([_unpack_sorted(x) for x in t.column("keys").to_pylist()]), np.concatenate([unpack(x, np.uint32).astype(np.int64) for x in t.column("counts").to_pylist()]))
            b = t.column("bucket")[0].as_py()
            _save(f"{path}/v{b:07d}.npy", keys)
            _save(f"{path}/n{b:07d}.npy", _small(counts))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["bucket", "n", "total"])

    texts = docs.select("text")
    grouped = texts.mapInArrow(words, _PACKED).repartition("bucket").sortWithinPartitions("bucket")
    sizes = {r["bucket"]: r for r in grouped.mapInArrow(merge_words, "bucket int, n long, total long").collect()}
    offset = np.zeros((1 << bits) + 1, np.int64)
    offset[[b + 1 for b in sizes]] = [r["n"] for r in sizes.values()]
    offset = np.cumsum(offset)
    v, total = int(offset[-1]), sum(r["total"] for r in sizes.values())
    if v >= (1 << 32) - 1:
        raise ValueError("n-gram keys hold vocabularies below 2**32 words")
    hot = max(1, int(total * HOT_SHARE / (1 << bits)))
    meta = {"bits": bits, "offset": offset, "words": v, "tokens": total, "hot": hot, "slices": 1 << bits, "width": max(1, -(-(v + 1) // (1 << bits)))}

    def longest(batches):
        held = _GramCounter(path, meta, order)
        for batch in batches:
            for i, j, texts in text_slices(batch.column(0)):
                ids, first = token_ids(path, meta, texts)
                grams = [*grams_before(ids, first, v, order - 1), ids]
                whole = grams[0] >= 0
                yield from held.add([x[whole] for x in grams])
        yield from held.flush()

    def beginnings(batches):
        held = {k: _GramCounter(path, meta, k) for k in range(2, order)}
        for batch in batches:
            for i, j, texts in text_slices(batch.column(0)):
                ids, first = token_ids(path, meta, [b" ".join(x.split(None, order)[:order]) for x in texts])
                for k, counter in held.items():
                    grams = [*grams_before(ids, first, v, k - 1), ids]
                    opening = grams[0] == v
                    yield from counter.add([x[opening] for x in grams])
        for counter in held.values():
            yield from counter.flush()

    def stats(b: int, counts: np.ndarray) -> tuple:
        return 0, b, b"", json.dumps([int((counts == x).sum()) for x in (1, 2, 3, 4)]).encode()

    def by_slice(kind: int, ids: np.ndarray, sums: np.ndarray):
        for b, lo, hi in parts((ids // U(meta["width"])).astype(np.int64)):
            yield kind, b, _pack_sorted(ids[lo:hi].astype(np.uint64)), pack(sums[lo:hi].astype(np.uint64))

    def pairs(b: int, ids: list[np.ndarray], counts: np.ndarray):
        """Writes counted pairs of a bucket, in order; yields numbers of them and of the words they end in. Contexts that are split get their numbers summed later."""
        if not len(counts):
            return
        split = _splits(path, meta, ids[0]) > 1
        for tag, some in (("p", ~split), ("q", split)):
            if some.any():
                _save_followers(f"{path}/{tag}-{b:07d}.npy", ids[0][some], ids[1][some], counts[some])
        rows = [stats(b, counts)]
        context, *sums = summed(ids[0][split], counts[split], *((counts[split] == x).astype(np.int64) for x in (1, 2)), (counts[split] > 2).astype(np.int64))
        for kind, column in enumerate(sums, 11):
            rows += by_slice(kind, context, column)
        yield _batch([*rows, *by_slice(15, *summed(ids[1], np.ones(len(counts), np.int64)))])

    def merged(k: int):
        def work(batches):
            for t in _by_group(batches, ["bucket"]):
                columns, counts = gathered_grams(t)
                b, ids = t.column("bucket")[0].as_py(), gram_ids(columns, k)
                if k == 2:
                    yield from pairs(b, ids, counts)
                    continue
                context = gram_hash(ids[:-1])
                by_context = gram_order([context, ids[-1]])
                _save_followers(f"{path}/u{k}-{b:07d}.npy", context[by_context], ids[-1][by_context], counts[by_context])
                _save(f"{path}/s{k}-{b:07d}.npy", np.array([(counts == x).sum() for x in (1, 2, 3, 4)]))
                shorter, counts = summed_grams(gram_columns(ids[1:]), np.ones(len(counts), np.int64))
                if k == 3:
                    # Pairs of words that aren't split are complete here.
                    two = gram_ids(shorter, 2)
                    whole = _splits(path, meta, two[0]) == 1
                    yield from pairs(b, [x[whole] for x in two], counts[whole])
                    shorter, counts = [x[~whole] for x in shorter], counts[~whole]
                yield from gram_rows(path, meta, shorter, counts, k - 1)

        return work

    counted, done = texts.mapInArrow(longest, _PACKED), None
    for k in range(order, 1, -1):
        out = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged(k), _PACKED)
        if k > 2:
            out = out.union(texts.mapInArrow(beginnings, _PACKED).filter(F.col("kind") == k - 1))
        if k <= 3:
            out = stage_table(spark, out, f"merged{k}")
            sums = out.filter("kind = 0 or kind > 10")
            done = sums if done is None else done.union(sums)
        counted = out.filter(F.col("kind") == k - 1)
    n2 = np.zeros(4, np.int64)
    for r in done.filter("kind = 0").select("counts").collect():
        n2 += json.loads(bytes(r["counts"]))

    def merge_sums(batches):
        for t in _by_group(batches, ["kind", "bucket"]):
            kind, b = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
            ids, sums = summed(np.concatenate([_unpack_sorted(x) for x in t.column("keys").to_pylist()]), np.concatenate([unpack(x, np.uint64).astype(np.int64) for x in t.column("counts").to_pylist()]))
            _save(f"{path}/i{kind}-{b:07d}.npy", ids.astype(np.uint32))
            _save(f"{path}/d{kind}-{b:07d}.npy", _small(sums))
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([[int(sums.sum()), *(int((sums == k).sum()) for k in (1, 2, 3, 4)), int((sums > 2).sum())]], pa.list_(pa.int64()))], ["kind", "stats"])

    grouped = done.filter("kind > 10").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    left = np.zeros(6, np.int64)
    for r in grouped.mapInArrow(merge_sums, "kind int, stats array<long>").collect():
        left += r["stats"] if r["kind"] == 15 else 0
    d1, d2 = discounts(left[1:5].tolist()), discounts(n2.tolist())
    gamma = float((d1[0] * left[1] + d1[1] * left[2] + d1[2] * left[5]) / left[0]) if left[0] else 1.0
    upper = {}
    for k in range(3, order + 1):
        files = [f"{path}/s{k}-{b:07d}.npy" for b in range(1 << bits)]
        upper[k] = discounts(sum((np.load(f) for f in files if os.path.exists(f)), np.zeros(4, np.int64)).tolist())
    return meta | {"d1": d1, "d2": d2, "types": int(left[0]), "gamma": gamma, "upper": upper}


def token_ids(path: str, meta: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The id of every token, -1 if unknown; and the first token of each text."""
    hashes, first, _ = tokens(texts)
    distinct, back = np.unique(hashes, return_inverse=True)
    return _ids(path, meta, distinct)[back], first


def score(path: str, meta: dict, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score, score of each text."""
    # Of distinct words first: their ids, counts, splits and probabilities.
    hashes, first, _ = tokens(texts)
    distinct, back = np.unique(hashes, return_inverse=True)
    v, id_of = meta["words"], _ids(path, meta, distinct)
    there = id_of >= 0
    word = id_of[there]
    count, split_of, single = np.zeros(len(distinct), np.int64), np.ones(len(distinct), np.int64), np.full(len(distinct), meta["gamma"] / (v + 1))
    if len(word):
        count[there] = _counts(path, meta, word)
        split_of[there] = -(-count[there] // meta["hot"])
        left = _sum_of(path, meta, 15, word)
        single[there] += (left - _discount(meta["d1"], left)) / meta["types"]
    ids, splits, p = id_of[back], split_of[back], single[back]
    known, base = ids >= 0, np.log10((count + 1) / (meta["tokens"] + (v + 1)))[back]
    for k, d in {2: meta["d2"], **meta["upper"]}.items():
        before = grams_before(ids, first, v, k - 1)
        has = np.flatnonzero(np.all([x >= 0 for x in before], axis=0))
        before, last = [x[has] for x in before], ids[has]
        around = np.minimum.reduce([x[has] for x in gram_core([*grams_before(splits, first, 1 << meta["bits"], k - 1), splits])])
        bucket = gram_buckets(path, meta, [*before, last], around)
        if k == 2:
            split = around > 1
            found = np.zeros((5, len(has)), np.int64)
            for tag, some in (("p", ~split), ("q", split)):
                found[:, some] = _looked_up(path, tag, meta["bits"], bucket[some], before[0][some].astype(np.uint64), last[some])
            context, again = np.unique(before[0][split], return_inverse=True)
            found[:4, split] = np.array([_sum_of(path, meta, kind, context)[again] for kind in (11, 12, 13, 14)])
        else:
            found = _looked_up(path, f"u{k}", meta["bits"], bucket, gram_hash(before), last)
        seen = found[0] > 0
        has, (total, one, two, more, c) = has[seen], found[:, seen]
        p[has] = (np.maximum(c - _discount(d, c), 0) + (d[0] * one + d[1] * two + d[2] * more) * p[has]) / total
    n = np.diff(first)
    add = lambda x: np.add.reduceat(x, first[:-1])
    return n, add(known.astype(np.int64)), add(base), add(np.log10(p))


@functools.lru_cache(maxsize=1 << 17)
def _exists(path: str) -> bool:
    return os.path.exists(path)


def _sum_of(path: str, meta: dict, kind: int, ids: np.ndarray) -> np.ndarray:
    """Sums of a kind of sorted distinct ids; 0 where there are none."""
    out = np.zeros(len(ids), np.int64)
    for b, lo, hi in parts(ids // meta["width"]):
        if _exists(f"{path}/i{kind}-{b:07d}.npy"):
            at, there = _at(_mapped(f"{path}/i{kind}-{b:07d}.npy"), ids[lo:hi])
            out[lo:hi] = np.where(there, _mapped(f"{path}/d{kind}-{b:07d}.npy")[at], 0)
    return out


def score_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` isn't
    ``held_fold``; a null id trains. Texts are lower-cased in A-Z; a null text is
    empty and has the end token only. Repeated rows count as often as they come;
    other columns are ignored. Without training rows every word is unknown and
    has probability 1. ``score`` is of the n-gram model of ``order`` words;
    ``base_score`` is the add-one unigram model's.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_binary(text_col).alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    folder = new_folder(spark, "ngrams")
    meta = train(spark, given.filter(~held), folder, order)
    path = local_path(folder)

    def work(batches):
        for batch in batches:
            for i, j, texts in text_slices(batch.column(2)):
                n, known, base, full = score(path, meta, texts)
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(known), pa.array(np.full(j - i, meta["tokens"])), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return given.select("doc_id", held.alias("held_out"), "text").mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
