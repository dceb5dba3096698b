"""Vectorised tokenising and hashing of UTF-8 texts with numpy.

Works on blocks of joined texts, so that its memory follows the block size and
the longest single text, not the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BLOCK = 1 << 20
#: Bytes of text that a worker turns into arrays at a time; up to 60 bytes of arrays stand for each.
SLICE = 1 << 21
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("_POW", _P), ("_INV", _PINV)):
            x = np.full(size, U(base))
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            globals()[name] = x
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """Words of several texts: ``start``/``end`` byte positions in ``buf``, ``first[i]`` the first word of text i, ``hash`` if asked for."""

    __slots__ = ("buf", "start", "end", "first", "hash", "base")

    def __init__(self, texts: list[bytes], lower: bool = False, hashed: bool = True):
        joined = b"\n".join(texts)
        if lower:
            joined = joined.lower()
        self.buf = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = np.concatenate(([0], np.cumsum(lengths + 1)))
        inside = np.zeros(len(self.buf) + 2, np.int8)
        np.logical_not(_SPACE[self.buf], out=inside[1:-1].view(bool))
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.base)
        self.hash = self._hashes() if hashed else None

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i, n = 0, len(self.start)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK, "right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            power, inverse = _powers(hi - lo + 1)
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[self.buf[lo:hi]] * power[: hi - lo], out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * U(0xD1B54A32D192ED03))
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words; those that cross texts must be masked by the caller."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * U(0xD6E8FEB86659FD93) + hashes[k : k + m]
    return mix(out)


def inside_one(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which a run of n words lies inside one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, np.int64)
    counts = np.diff(first)
    owner_end = np.repeat(first[1:], counts)
    at = np.arange(total)
    return at[at + n <= owner_end]


def slices(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together, a longer row on its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def bytes_of(column) -> list[bytes]:
    """The texts of an Arrow binary or string column; null is empty."""
    import pyarrow as pa

    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def text_slices(column, most: int = SLICE) -> Iterator[tuple[int, int, list[bytes]]]:
    """First row, row after the last, and texts of runs of rows; only one run is held as Python objects."""
    import pyarrow.compute as pc

    for i, j in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield i, j, bytes_of(column.slice(i, j - i))


def segmented_unique(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner, then value."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    keep = np.ones(len(o), bool)
    keep[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return o[keep], v[keep]
