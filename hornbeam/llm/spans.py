"""Spans found in byte strings, reported in code points."""

from __future__ import annotations

import hashlib

import numpy as np

Span = tuple[str, int, int]


def in_code_points(text: bytes, spans: list[Span]) -> list[Span]:
    """Byte offsets at character borders to code-point offsets."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(k, int(before[a]), int(before[b])) for k, a, b in spans]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed (others after, by name), then end; comma-joined."""
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], place.get(s[0], len(kinds)), s[0], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def find_rows(buf: bytes, base: np.ndarray, needle: bytes, hit: np.ndarray) -> None:
    """Marks in ``hit`` the texts, starting at ``base`` in ``buf``, that hold ``needle``."""
    at = buf.find(needle)
    while at >= 0:
        row = int(np.searchsorted(base, at, "right")) - 1
        hit[row] = True
        at = buf.find(needle, int(base[row + 1]))
