"""Secret scans through nested encodings.

Every text is a layer; a worklist decodes URL escapes, Unicode and HTML
escapes, base64, also wrapped to lines, hex and compressed runs into further
layers until nothing new appears at the same place. Escapes are replaced in the whole layer and in
each run without white space. Each layer is scanned and its spans are mapped to the text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary
from .spans import Span, digest, find_rows, in_code_points, joined
from .textops import text_slices

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_URL = re.compile(rb"%[0-9A-Fa-f]{2}")
_UNICODE = re.compile(rb"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&(amp|lt|gt|quot|apos);")
_PACKED = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64; the breaks may be escaped as in JSON.
_BREAK = re.compile(rb"[ \t]*+(?:\r?\n|(?:\\r)?\\n)[ \t]*+")
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:%s[A-Za-z0-9+/_-]++)++={0,2}" % _BREAK.pattern)
_HEXRUN = re.compile(rb"[0-9A-Fa-f]{32,}")
_MAGIC = ((b"\x1f\x8b", 31), (b"\x78\x01", 15), (b"\x78\x5e", 15), (b"\x78\x9c", 15), (b"\x78\xda", 15), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"))
#: A compressed layer unfolds in layers of so many bytes, each beginning with so many of the one before.
MOST_UNFOLDED, OVERLAP = 1 << 26, 1 << 20
#: Bytes read and unfolded at a time.
_STEP = 1 << 16
#: Chains of ever new layers end here; rows whose scan was stopped so are flagged.
MOST_DEPTH = 64
_TELLING = re.compile(rb"passw|secret|token|api_?key|AKIA[A-Z0-9]{14}", re.I)


def scan(layer: bytes) -> list[Span]:
    """The base findings of one layer, in bytes."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(layer) if m.end(2) - m.start(2) >= 12]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(layer) if m.end() - m.start() >= 18]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(layer)]


def _mixed(run: bytes) -> bool:
    """Whether a run of base64 letters looks like more than a word: two of upper case inside, lower case, digits or signs."""
    return (any(65 <= c <= 90 for c in run[1:])) + (any(97 <= c <= 122 for c in run)) + (any(c < 65 or c in b"_" for c in run)) >= 2


def _plausible(data: bytes) -> bool:
    if len(data) < 8:
        return False
    if any(data.startswith(m) for m, _ in _MAGIC) or _TELLING.search(data):
        return True
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.95 * len(text)


def _unpacked(data: bytes) -> Iterator[bytes]:
    """What all members of compressed data hold, as far as they are sound, in overlapping parts."""
    held, fresh, pos = bytearray(), False, 0
    while (how := next((h for m, h in _MAGIC if data.startswith(m, pos)), None)) is not None:
        deflated = isinstance(how, int)
        d = zlib.decompressobj(how) if deflated else bz2.BZ2Decompressor() if how == "bz2" else lzma.LZMADecompressor()
        piece = b""
        try:
            while not d.eof:
                if not piece and (deflated or d.needs_input):
                    if pos >= len(data):
                        break
                    piece = data[pos : pos + _STEP]
                    pos += len(piece)
                new = d.decompress(piece, _STEP)
                piece = d.unconsumed_tail if deflated else b""
                held += new
                fresh |= bool(new)
                if len(held) >= MOST_UNFOLDED:
                    yield bytes(held)
                    del held[: len(held) - OVERLAP]
                    fresh = False
            if not d.eof:
                if deflated:
                    new = d.flush()
                    held += new
                    fresh |= bool(new)
                break
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError):
            break
        pos -= len(d.unused_data)
        while pos < len(data) and not data[pos]:
            pos += 1
    if fresh:
        yield bytes(held)


def _tokens(layer: bytes, mark: re.Pattern) -> list[tuple[int, int]]:
    """Runs of non-space bytes that hold a match."""
    out: list[tuple[int, int]] = []
    for m in mark.finditer(layer):
        if out and m.start() < out[-1][1]:
            continue
        a, b = m.start(), m.end()
        while a and layer[a - 1] not in b" \t\r\n\x0b\x0c" and (not out or a > out[-1][1]):
            a -= 1
        while b < len(layer) and layer[b] not in b" \t\r\n\x0b\x0c":
            b += 1
        out.append((a, b))
    return out


Layer = tuple[bytes, np.ndarray, np.ndarray]


def _escaped(layer: Layer, a: int, b: int, mark: re.Pattern, value) -> Layer:
    """Part of a layer with every match of ``mark`` replaced; each byte keeps the range of the text it came from."""
    data, lo, hi = layer
    parts, los, his, at = [], [], [], a
    for m in mark.finditer(data, a, b):
        new = value(m)
        parts += [data[at : m.start()], new]
        los += [lo[at : m.start()], np.full(len(new), lo[m.start()])]
        his += [hi[at : m.start()], np.full(len(new), hi[m.end() - 1])]
        at = m.end()
    return b"".join([*parts, data[at:b]]), np.concatenate([*los, lo[at:b]]), np.concatenate([*his, hi[at:b]])


def _of_unicode(m: re.Match) -> bytes:
    code = m[1] or m[2] or m[3] or m[5]
    if m[6]:
        return html.unescape(f"&{m[6].decode()};").encode()
    n = int(m[4]) if m[4] else int(code, 16)
    return chr(n).encode("utf-8", "replace") if n < 0x110000 else m[0]


def _of_base64(layer: Layer, at: np.ndarray, run: bytes) -> Layer | None:
    """What base64 letters, at the places ``at`` of a layer, encode."""
    if not _mixed(run):
        return None
    run = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    for skip in range(4):
        part = run[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        try:
            raw = base64.b64decode(part + b"=" * (-len(part) % 4))
        except (binascii.Error, ValueError):
            continue
        if _plausible(raw):
            i = skip + np.arange(len(raw)) * 4 // 3
            return raw, layer[1][at[i]], layer[2][at[np.minimum(i + 1, len(at) - 1)]]
    return None


def _joined_lines(data: bytes) -> Iterator[tuple[np.ndarray, bytes]]:
    """Places and letters of consecutive base64 lines of one length, with and without a shorter last line and the line before."""
    for m in _WRAPPED.finditer(data):
        cut = [m.start(), *(x for b in _BREAK.finditer(data, m.start(), m.end()) for x in b.span()), m.end()]
        lines = list(zip(cut[::2], cut[1::2]))
        size = [len(data[a:b].rstrip(b"=")) for a, b in lines]
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and size[j] == size[i]:
                j += 1
            tail = j < len(lines) and size[j] < size[i]
            for first in ((i, i - 1) if i else (i,)):
                for last in ((j + 1, j) if tail else (j,)):
                    if last - first > 1 and size[i] >= 16:
                        part = lines[first:last]
                        yield np.concatenate([np.arange(a, b) for a, b in part]), b"".join(data[a:b] for a, b in part)
            i = j


def decoded(layer: Layer) -> Iterator[Layer]:
    """All layers one step further in."""
    data, lo, hi = layer
    for part in _unpacked(data):
        yield part, np.broadcast_to(lo.min(), len(part)), np.broadcast_to(hi.max(), len(part))
    for mark, value in ((_URL, lambda m: bytes([int(m[0][1:], 16)])), (_UNICODE, _of_unicode)):
        runs = _tokens(data, mark)
        if runs:
            yield _escaped(layer, 0, len(data), mark, value)
        for a, b in runs:
            yield _escaped(layer, a, b, mark, value)
    for m in _HEXRUN.finditer(data):
        raw = binascii.unhexlify(m[0][: len(m[0]) // 2 * 2])
        if _plausible(raw):
            at = m.start() + 2 * np.arange(len(raw))
            yield raw, lo[at], hi[at + 1]
    for m in _PACKED.finditer(data):
        inner = _of_base64(layer, np.arange(m.start(), m.end()), m[0])
        if inner:
            yield inner
    for at, run in _joined_lines(data):
        inner = _of_base64(layer, at, run)
        if inner:
            yield inner


def find(text: bytes) -> tuple[list[Span], list[Span], bool]:
    """The base spans of a text, those found in its inner layers, in bytes of the text, and whether a chain of layers was cut.

    A layer is what some range of the text encodes: equal layers of other ranges
    are scanned as well, those of one range, so also cycles, only once.
    """
    base, more, cut = scan(text), [], False
    mark = lambda data: data if len(data) < 64 else hashlib.blake2b(data).digest()
    seen = {(mark(text), 0, len(text))}
    at = np.arange(len(text) + 1)
    todo = [decoded((text, at[:-1], at[1:]))] if text else []
    while todo:
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
        elif inner[0] and (key := (mark(inner[0]), int(inner[1][0]), int(inner[2][-1]))) not in seen:
            seen.add(key)
            more += [(k, int(inner[1][a]), int(inner[2][b - 1])) for k, a, b in scan(inner[0])]
            if len(todo) < MOST_DEPTH:
                todo.append(decoded(inner))
            else:
                cut = cut or next(decoded(inner), None) is not None
    # A span of an inner layer may begin or end inside a character of the text.
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    fixed = []
    for k, a, b in more:
        while inside(a):
            a -= 1
        while inside(b):
            b += 1
        fixed.append((k, a, b))
    return base, fixed, cut


_CLASS = np.zeros(256, np.int8)
_CLASS[list(b"+/-_0123456789")] = 4
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(97, 123))] = 1
_HEXES = np.zeros(256, bool)
_HEXES[list(b"0123456789abcdef")] = True
_NEEDLES = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia", b"%", b"\\u", b"\\x", b"&#", b"&amp;", b"&lt;", b"&gt;", b"&quot;", b"&apos;")


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = b - a >= least
    return a[long], b[long]


def suspects(texts: list[bytes]) -> np.ndarray:
    """Which texts may hold anything at all: a needle, a run of 16 hex digits or a base64-like run of mixed letters."""
    buf = b"\n".join(texts)
    base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    hit = np.zeros(len(texts), bool)
    low = buf.lower()
    for needle in _NEEDLES:
        find_rows(low, base, needle, hit)
    raw = np.frombuffer(buf, np.uint8)
    a, _ = _runs(_HEXES[raw], 16)
    hit[np.searchsorted(base, a, "right") - 1] = True
    kind = _CLASS[raw]
    a, b = _runs(kind > 0, 16)
    if len(a):
        total = lambda bit: np.concatenate(([0], np.cumsum(kind == bit, dtype=np.int32)))
        up, down, other = total(2), total(1), total(4)
        mixed = (up[b] > up[a + 1]).astype(int) + (down[b] > down[a]) + (other[b] > other[a]) >= 2
        hit[np.searchsorted(base, a[mixed], "right") - 1] = True
    for i, t in enumerate(texts):
        if t[:1] and not hit[i] and any(t.startswith(m) for m, _ in _MAGIC):
            hit[i] = True
    return hit


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded, stopped: one row for each row of ``docs``.

    Counts and digest are of the base findings in the text itself; ``spans`` adds
    those of inner layers, under the same kinds, at the range of the text that
    encodes them; ``stopped`` tells that a chain of more than MOST_DEPTH layers
    was cut. A null text is empty; null ids and repeated rows are kept; an empty
    table gives an empty result; other columns are ignored. Texts without any
    suspicious run skip the scan. A very long text is scanned whole and needs
    about 40 bytes a byte in its worker, more only while layers are open.
    """

    def work(batches):
        for batch in batches:
            for i, j, texts in text_slices(batch.column(1)):
                rows = []
                for t, hit in zip(texts, suspects(texts).tolist()):
                    base, more, cut = find(t) if hit else ([], [], False)
                    both = in_code_points(t, base + more)
                    first = joined(both[: len(base)], KINDS)
                    rows.append((*(sum(s[0] == k for s in base) for k in KINDS), digest(first), joined(both, KINDS), len(set(both) - set(both[: len(base)])), cut))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "stopped"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_binary(text_col).alias("text"))
    return given.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, stopped boolean")
