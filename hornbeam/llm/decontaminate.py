"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so that a question with
other values has the same template. Hashed windows of benchmark templates are
hash-joined with those of all documents; matched windows are aligned with their
item, and they count only if each value of the item stands for one value of the
document throughout. Windows of the literal tokens, every value kept, find
verbatim copies also where a template has too few literals to tell anything.
A bitmap of the benchmark's hashes, of a fixed size, is sent to the tasks that
read documents: windows that cannot match never become rows.
"""

from __future__ import annotations

import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_binary, small, stage_table
from .near_dup import _by_group
from .textops import U, Words, inside_one, mix, text_slices, windows

WINDOW = 10
#: Fewer literal tokens than this in a template window, or tokens in a template, tell nothing; such text is found verbatim only.
LEAST_LITERAL = 5
#: Items of fewer bytes of words than this, like 'a b c d', are no text to look for.
LEAST_BYTES = 5
#: An item is found if so many tokens in a row match, or this share of its tokens.
RUN_TOKENS, SHARE = 13, 0.5
#: Bounds of the bitmap's bits, 16 for each window: 8 kB to 32 MB; a fuller one only lets more rows into the join.
LEAST_BITS, MOST_BITS, BITS_A_WINDOW = 1 << 16, 1 << 28, 16
#: Texts are matched in slices of so many bytes; about 60 bytes of arrays stand for each.
SLICE_BYTES = 1 << 20

_NUMBER_WORDS = b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
_UNITS = b"mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years dollar dollars usd cent cents euro euros eur percent degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules meter meters metre metres".split()
_NAMES = b"james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher nancy daniel lisa matthew betty anthony margaret mark sandra paul ashley steven kimberly andrew emily peter anna tom bob alice jack jill sam emma liam noah olivia ava mia lucas ethan sophia jacob ben kate jane joe mike tim maria jose juan carlos pierre marie hans greta".split()

_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".!?:\n\"'(")] = True
#: First and last characters of scripts without spaces, one token a character, and of punctuation beyond ASCII.
_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FFF), (0x3040, 0x312F), (0x31A0, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_STOPS = ((0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
NUM, UNIT, NAME = (mix(np.array([x], np.uint64))[0] for x in (11, 12, 13))
LITERAL, IS_NUM, IS_UNIT, IS_NAME = 0, 1, 2, 3


def folded(text: bytes) -> bytes:
    """Lower case, also beyond ASCII where that keeps every byte in its place."""
    if text.isascii():
        return text.lower()
    low = text.decode("utf-8", "replace").lower().encode()
    return low if len(low) == len(text) else text.lower()


def token_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of each token of UTF-8 bytes."""
    inside = ~_SEP[raw]
    cut = np.zeros(len(raw) + 1, bool)
    for least, most, n in ((0xE0, 0xEF, 3), (0xF0, 0xF4, 4)):
        at = np.flatnonzero((raw >= least) & (raw <= most))
        at = at[at + n <= len(raw)]
        code = raw[at].astype(np.int32) & (0x0F if n == 3 else 0x07)
        whole = np.ones(len(at), bool)
        for k in range(1, n):
            whole &= raw[at + k] & 0xC0 == 0x80
            code = code << 6 | raw[at + k] & 0x3F
        within = lambda ranges: whole & np.any([(code >= a) & (code <= b) for a, b in ranges], axis=0)
        alone = at[within(_ALONE)]
        cut[alone] = cut[alone + n] = True
        stop = at[within(_STOPS)]
        for k in range(n):
            inside[stop + k] = False
    before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))


class Templates:
    """Tokens of several texts: literal hash, kind, and the template hash with names kept (0) or replaced (1).

    ``literal``, ``length`` and ``literal_first`` are of the tokens before numbers
    are joined; ``group`` is the place of each among the joined ones.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        w = Words.__new__(Words)
        w.buf = np.frombuffer(b"\n".join(folded(t) for t in texts), np.uint8)
        base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        w.start, w.end = token_bounds(raw)
        first = np.searchsorted(w.start, base)
        literal = w._hashes()
        digits = np.concatenate(([0], np.cumsum(_DIGIT[raw], dtype=np.int32)))
        number = (digits[w.end] - digits[w.start] == w.end - w.start) | np.isin(literal, _known()[0])
        # 3.14, 1,000 and twenty five are one number.
        opens = np.zeros(len(literal) + 1, bool)
        opens[first[:-1]] = True
        drop = np.zeros(len(literal), bool)
        drop[1:] = number[1:] & number[:-1]
        drop &= ~opens[:-1]
        group = np.cumsum(~drop) - 1
        keep = ~drop
        value = np.zeros(int(keep.sum()), np.uint64)
        if drop.any():
            place = np.arange(len(literal)).astype(np.uint64)
            np.add.at(value, group, np.where(drop, mix(literal + (place - np.maximum.accumulate(np.where(keep, place, U(0))))), literal))
        else:
            value = literal.copy()
        kind = np.zeros(len(value), np.int8)
        kind[np.isin(literal[keep], _known()[1])] = IS_UNIT
        kind[number[keep]] = IS_NUM
        upper = _UPPER[raw[w.start]] if len(w.start) else np.zeros(0, bool)
        second = np.minimum(w.start + 1, max(len(raw) - 1, 0))
        title = upper & (w.end - w.start > 1) & (_LOWER[raw[second]] if len(raw) else upper)
        # A capital at the start of a text, line or sentence says nothing.
        gap = np.zeros(len(literal), bool)
        gap[0:1] = True
        marks = np.concatenate(([0], np.cumsum(_MARK[raw], dtype=np.int32)))
        gap[1:] = marks[w.start[1:]] > marks[w.end[:-1]]
        named = (title & ~gap) | (title & np.isin(literal, _known()[2]))
        self.value, self.kind = value, kind
        self.literal, self.length, self.literal_first, self.group = literal, w.end - w.start, first, group
        named = named[keep] & (kind == LITERAL)
        self.first = np.concatenate(([0], np.cumsum(keep)))[first]
        plain = np.where(kind == IS_NUM, NUM, np.where(kind == IS_UNIT, UNIT, value))
        self.template = (plain, np.where(named, NAME, plain))
        self.kinds = (kind, np.where(named, IS_NAME, kind))


#: The variant of literal windows; 0 keeps names, 1 replaces them.
_VERBATIM = 2
_cache: list[np.ndarray] = []


def _known() -> list[np.ndarray]:
    if not _cache:
        _cache.extend(Words([b" ".join(x)]).hash for x in (_NUMBER_WORDS, _UNITS, _NAMES))
    return _cache


def _literal_enough(kind: np.ndarray, n: int) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(kind == LITERAL)))
    return sums[n:] - sums[:-n] >= min(n, LEAST_LITERAL)


#: A window: variant, length, hash, text, position, and for items the number of tokens, of literal tokens, and what the verdict needs of each token.
Window = tuple[int, int, int, int, int, int, int, bytes]
#: A matched window of one document and one item: variant, length, place in the document less that in the item, place in the item, the document's values, and the last three of Window.
Match = tuple[int, int, int, int, bytes, int, int, bytes]


def item_windows(texts: list[bytes]) -> list[Window]:
    """All windows of benchmark items; items shorter than WINDOW are one window of their own length."""
    t = Templates(texts)
    size, literal_size = np.diff(t.first), np.diff(t.literal_first)
    letters = np.diff(np.concatenate(([0], np.cumsum(t.length)))[t.literal_first])
    kind = np.maximum(*t.kinds)
    out: list[Window] = []

    def add(variant: int, n: int, hashes: np.ndarray, first: np.ndarray, at: np.ndarray, owner: np.ndarray) -> None:
        for h, i, o in zip(windows(hashes, n)[at].view(np.int64).tolist(), at.tolist(), owner.tolist()):
            info = t.group[i : i + n].astype(np.int32).tobytes() if variant == _VERBATIM else kind[i : i + n].tobytes() + t.value[i : i + n].tobytes()
            out.append((variant, n, h, o, i - int(first[o]), int(size[o]), int(literal_size[o]), info))

    for variant in (0, 1):
        for n in sorted({min(WINDOW, int(s)) for s in size if s >= LEAST_LITERAL}):
            at = inside_one(t.first, n)
            at = at[_literal_enough(t.kinds[variant], n)[at]]
            owner = np.searchsorted(t.first, at, "right") - 1
            fit = np.minimum(size[owner], WINDOW) == n
            add(variant, n, t.template[variant], t.first, at[fit], owner[fit])
    for n in sorted({min(WINDOW, int(s)) for s in literal_size[letters >= LEAST_BYTES]}):
        at = inside_one(t.literal_first, n)
        owner = np.searchsorted(t.literal_first, at, "right") - 1
        fit = (np.minimum(literal_size[owner], WINDOW) == n) & (letters[owner] >= LEAST_BYTES)
        add(_VERBATIM, n, t.literal, t.literal_first, at[fit], owner[fit])
    return out


class Bitmap:
    """Which hashes may occur: no bit is missing, some are set by others."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.mask = packed, len(packed) * 8 - 1

    def has(self, h: np.ndarray) -> np.ndarray:
        i = (h & U(self.mask)).astype(np.int64)
        return (self.packed[i >> 3] >> (i & 7).astype(np.uint8)) & 1 > 0


def text_windows(texts: list[bytes], lengths: list[tuple[int, int]], maybe: Bitmap) -> list[tuple[int, int, int, int, int, bytes]]:
    """Of documents the windows (variant, length, hash, text, position, values of its slots) that may be an item's."""
    t = Templates(texts)
    out = []
    names = np.concatenate(([0], np.cumsum(t.kinds[1] == IS_NAME)))
    for variant, n in lengths:
        hashes, first = (t.literal, t.literal_first) if variant == _VERBATIM else (t.template[variant], t.first)
        at = inside_one(first, n)
        h = windows(hashes, n)[at]
        if variant == 1:
            # Without names the window is the same as with names kept.
            named = names[at + n] > names[at]
            at, h = at[named], h[named]
        some = maybe.has(h)
        at, h = at[some], h[some]
        owner = np.searchsorted(first, at, "right") - 1
        for x, o, i in zip(h.view(np.int64).tolist(), owner.tolist(), at.tolist()):
            slots = b""
            if variant != _VERBATIM:
                slots = b"".join(struct.pack("<BQ", k, int(t.value[i + k])) for k in np.flatnonzero(t.kinds[variant][i : i + n]).tolist())
            out.append((variant, n, x, o, i - int(first[o]), slots))
    return out


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers, given in order."""
    out: list[list[int]] = []
    for x in places:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(a, b) for a, b in out]


def matched_tokens(rows: list[Match]) -> int | None:
    """How many tokens of an item a document has in a row, if enough to call it found."""
    enough = lambda n, size: n >= min(size, RUN_TOKENS) or n >= SHARE * size
    templates: dict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)
    literals: dict[int, dict[int, int]] = defaultdict(dict)
    size = literal_size = 0
    for variant, n, shift, place, slots, size, literal_size, info in rows:
        if variant == _VERBATIM:
            literals[shift].update(zip(range(place, place + n), np.frombuffer(info, np.int32).tolist()))
            continue
        kinds, mine = info[:n], np.frombuffer(info[n:], np.uint64).tolist()
        theirs = dict(struct.iter_unpack("<BQ", slots))
        for k in range(n):
            templates[shift][place + k] = (kinds[k], mine[k], theirs.get(k, mine[k]))
    best = copied = 0
    for covered in templates.values():
        # Overlapping windows at one shift form runs. If the slots of all of them disagree, only stretches with the item's own values count.
        slots: dict[tuple[int, int], int] = {}
        places = sorted(covered)
        if not all(slots.setdefault(covered[k][:2], covered[k][2]) == covered[k][2] for k in places if covered[k][0] != LITERAL):
            places = [k for k in places if covered[k][1] == covered[k][2]]
        best = max([best, *(b - a + 1 for a, b in _runs(places))])
    for covered in literals.values():
        # The groups count numbers that are joined as one token.
        copied = max([copied, *(covered[b] - covered[a] + 1 for a, b in _runs(sorted(covered)) if enough(b - a + 1, literal_size))])
    return max(best, copied) if copied or (best and enough(best, size)) else None


def found_in(items: list[bytes], texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, item, matched tokens) of every item found in a text, without Spark."""
    index = defaultdict(list)
    for w in item_windows(items):
        index[w[:3]].append(w)
    packed = np.zeros(LEAST_BITS // 8, np.uint8)
    for _, _, h in index:
        i = h & (LEAST_BITS - 1)
        packed[i >> 3] |= 1 << (i & 7)
    pairs = defaultdict(list)
    for variant, n, h, text, pos, slots in text_windows(texts, sorted({k[:2] for k in index}), Bitmap(packed)):
        for _, _, _, item, place, *rest in index.get((variant, n, h), ()):
            pairs[text, item].append((variant, n, pos - place, place, slots, *rest))
    found = ((*key, matched_tokens(rows)) for key, rows in sorted(pairs.items()))
    return [x for x in found if x[2]]


def _bench_windows(items: DataFrame) -> DataFrame:
    """variant, n, h, item, place, size, literal_size, info of distinct item texts (item, text)."""

    def work(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, texts in text_slices(batch.column(1), SLICE_BYTES):
                rows = item_windows(texts)
                if rows:
                    v, n, h, o, place, size, literal_size, info = zip(*rows)
                    numbers = (pa.array(x, t) for x, t in ((v, pa.int32()), (n, pa.int32()), (h, pa.int64()), ([keys[i + k] for k in o], pa.int64()), (place, pa.int32()), (size, pa.int32()), (literal_size, pa.int32())))
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(info, pa.binary())], ["variant", "n", "h", "item", "place", "size", "literal_size", "info"])

    return items.select("item", "text").mapInArrow(work, "variant int, n int, h long, item long, place int, size int, literal_size int, info binary")


def _bitmap(bench: DataFrame) -> np.ndarray:
    """The bitmap of all hashes, made in slices of 1 kB by tasks; what reaches the driver is at most MOST_BITS."""
    bits = LEAST_BITS
    count = bench.count()
    while bits < min(MOST_BITS, count * BITS_A_WINDOW):
        bits *= 2

    def work(batches):
        for t in _by_group(batches, ["slice"]):
            part = np.zeros(8192, bool)
            part[t.column("bit").to_numpy()] = True
            yield pa.RecordBatch.from_arrays([pa.array([t.column("slice")[0].as_py()], pa.int64()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["slice", "part"])

    at = bench.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("i")).distinct()
    rows = at.select(F.shiftright("i", 13).alias("slice"), F.col("i").bitwiseAND(F.lit(8191)).cast("int").alias("bit")).repartition("slice").sortWithinPartitions("slice").mapInArrow(work, "slice long, part binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["slice"] * 1024 : r["slice"] * 1024 + 1024] = np.frombuffer(r["part"], np.uint8)
    return out


def unchecked_items(spark: SparkSession, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id of the items that no document can match: without text or with fewer than LEAST_BYTES bytes of words."""
    given = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    texts = stage_table(spark, given.filter("text is not null").select("text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    known = texts.join(_bench_windows(texts).select("item").distinct(), "item", "left_semi").select("text")
    return given.join(known, "text", "left_anti").select("item_id")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, matched_tokens, item_tokens: one row for each item found in each row of ``docs``.

    Equal item texts are looked up once. Null or empty texts and items of fewer
    than LEAST_BYTES bytes of words match nothing (``unchecked_items`` lists
    them); items and windows of fewer than LEAST_LITERAL literal tokens are found
    verbatim only, case and punctuation aside. Characters of scripts without
    spaces are tokens. Tokens are reported with adjacent numbers as one; null ids
    are kept as null; repeated rows are reported as often as they come; other
    columns, whatever their names, are ignored; an empty table gives an empty
    result. A very long text is looked up whole, with about 60 bytes of arrays a
    byte in its worker.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).filter("text is not null")
    texts = stage_table(spark, items.select("text").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    named = stage_table(spark, items.join(texts, "text").select("item", "item_id"), "item_ids")
    bench = stage_table(spark, _bench_windows(texts), "windows")
    lengths = sorted((r["variant"], r["n"]) for r in bench.select("variant", "n").distinct().collect())
    bits = spark.sparkContext.broadcast(_bitmap(bench))

    def work(batches):
        maybe, seen = Bitmap(bits.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, some in text_slices(batch.column(1), SLICE_BYTES):
                rows = text_windows(some, lengths, maybe)
                if rows:
                    v, n, h, o, pos, slots = zip(*rows)
                    columns = ((v, pa.int32()), (n, pa.int32()), (h, pa.int64()), ([seen + k for k in o], pa.int64()), ([ids[i + k] for k in o], pa.int64()), (pos, pa.int32()), (slots, pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["variant", "n", "h", "row", "doc_id", "pos", "slots"])
                seen += j - i

    def judge(batches):
        for t in _by_group(batches, ["row", "item"]):
            first = {k: t.column(k)[0].as_py() for k in ("doc_id", "item", "size")}
            n = matched_tokens(list(zip(*(t.column(k).to_pylist() for k in ("variant", "n", "shift", "place", "slots", "size", "literal_size", "info")))))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (first["doc_id"], first["item"], n, first["size"])], ["doc_id", "item", "matched_tokens", "item_tokens"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_binary(text_col).alias("text"))
    hits = given.mapInArrow(work, "variant int, n int, h long, row long, doc_id long, pos int, slots binary")
    matches = hits.join(bench, ["variant", "n", "h"]).select("row", "item", "doc_id", "variant", "n", (F.col("pos") - F.col("place")).alias("shift"), "place", "slots", "size", "literal_size", "info")
    found = matches.repartition("row", "item").sortWithinPartitions("row", "item").mapInArrow(judge, "doc_id long, item long, matched_tokens long, item_tokens long")
    return found.join(small(named), "item").select("doc_id", "item_id", "matched_tokens", "item_tokens")
