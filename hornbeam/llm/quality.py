"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown on a bounded sample of labelled documents, then flattened
into node arrays that score whole Arrow batches with numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_binary, smallest, stage_table
from .textops import U, Words, inside_one, mix, text_slices, windows

WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature name and the direction in which quality may move as it grows (0: either).
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_ratio", -1), ("dup_line_ratio", -1), ("repeat_ratio", -1), ("upper_ratio", -1),
    ("shout_ratio", -1), ("digit_ratio", 0), ("pipe_ratio", -1), ("words_a_line", 0), ("stop_ratio", 0), ("non_ascii_ratio", 0), ("distinct_ratio", 0),
)


def _lut(chars: bytes) -> np.ndarray:
    x = np.zeros(256, bool)
    x[list(chars)] = True
    return x


_SYMBOL, _UPPER, _LETTER = _lut(b"#*$%&|<>"), _lut(bytes(range(65, 91))), _lut(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _SHOUT, _PIPE, _STOP = _lut(b"0123456789"), _lut(b"!"), _lut(b"|"), _lut(b".?")
_NEWLINE, _HIGH, _POINT = _lut(b"\n"), _lut(bytes(range(128, 256))), ~_lut(bytes(range(128, 192)))


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of each text."""
    w = Words(texts)
    n = w.counts()
    ends = w.base[1:] - 1

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[ends] - sums[w.base[:-1]]

    inside = np.zeros(len(w.buf) + 1, np.int8)
    inside[w.start] += 1
    np.subtract.at(inside, w.end, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    chars = count(inside & _POINT[w.buf])
    symbols = count(_SYMBOL[w.buf])
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > len(set(lines)):
            worded = [x for x in lines if x.strip()]
            dup[i] = len(worded) - len(set(worded))
    owner = w.owner()
    at = inside_one(w.first, WINDOW)
    key = mix(windows(w.hash, WINDOW)[at] + owner[at].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    covered = np.zeros(len(w.hash) + 1, np.int32)
    if len(key):
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.subtract.at(covered, at[twice] + WINDOW, 1)
    sums = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    repeat = sums[w.first[1:]] - sums[w.first[:-1]]
    pair = np.sort(mix(w.hash + owner.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(24) | owner.astype(np.uint64) << U(40))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    distinct = np.bincount((pair[fresh] >> U(40)).astype(np.int64), minlength=len(texts))
    base = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
    words, letters, size = np.maximum(n, 1), np.maximum(count(_LETTER[w.buf]), 1), np.maximum(ends - w.base[:-1], 1)
    lines = count(_NEWLINE[w.buf]) + 1
    x = np.stack(
        [
            np.log1p(n), chars / words, symbols / words, dup / lines, repeat / words, count(_UPPER[w.buf]) / letters, count(_SHOUT[w.buf]) / words,
            count(_DIGIT[w.buf]) / size, count(_PIPE[w.buf]) / words, n / lines, count(_STOP[w.buf]) / words, count(_HIGH[w.buf]) / size, distinct / words,
        ],
        1,
    ).astype(np.float64)
    return base, x


@dataclass
class Forest:
    """Trees flattened into arrays: inner nodes go left where x[feature] <= threshold, leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: int = 20) -> Forest:
    """Boosts logistic-loss trees on histogram bins; splits and leaf values obey the monotonic directions.

    A split on a constrained feature must order its children's values, and the
    midpoint bounds every value further down. Without both classes the forest
    has no trees and accepts by the prior, everything where there are no rows.
    """
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots: list[int] = []
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    bias = float(np.log((pos + 1) / (neg + 1e-3))) if not pos or not neg else float(np.log(pos / neg))
    if pos and neg:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(x), bias)

        def node(val: float) -> int:
            at = len(value)
            feature.append(0)
            threshold.append(np.inf)
            left.append(at)
            right.append(at)
            value.append(val)
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            root = node(0.0)
            roots.append(root)
            todo = [(root, np.arange(len(x)), 0, -np.inf, np.inf)]
            while todo:
                at, rows, level, low, high = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[at] = rate * float(np.clip(gs / (hs + ridge), low, high))
                margin_add = value[at]
                best = (1e-6, None)
                if level < depth and len(rows) >= 2 * least:
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        k = codes[rows, f]
                        gl, hl, nl = (np.cumsum(np.bincount(k, weights, len(c) + 1))[:-1] for weights in (g[rows], h[rows], None))
                        vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((gs - gl) / (hs - hl + ridge), low, high)
                        score = lambda v, a, b: a * v - 0.5 * (b + ridge) * v * v
                        gain = score(vl, gl, hl) + score(vr, gs - gl, hs - hl) - score(np.clip(gs / (hs + ridge), low, high), gs, hs)
                        ok = (nl >= least) & (len(rows) - nl >= least) & (directions[f] * (vr - vl) >= 0)
                        gain = np.where(ok, gain, -np.inf)
                        b = int(np.argmax(gain))
                        if gain[b] > best[0]:
                            best = (float(gain[b]), (f, b, float(vl[b]), float(vr[b])))
                if best[1] is None:
                    margin[rows] += margin_add
                    continue
                f, b, vl, vr = best[1]
                feature[at], threshold[at] = f, float(cuts[f][b])
                go = codes[rows, f] <= b
                left[at], right[at] = node(0.0), node(0.0)
                mid = (vl + vr) / 2
                d = directions[f]
                todo.append((left[at], rows[go], level + 1, mid if d < 0 else low, mid if d > 0 else high))
                todo.append((right[at], rows[~go], level + 1, mid if d > 0 else low, mid if d < 0 else high))
    return Forest(np.array(feature or [0]), np.array(threshold or [np.inf]), np.array(left or [0], np.int32), np.array(right or [0], np.int32), np.array(value or [0.0]), np.array(roots, np.int64), depth, bias)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> Forest:
    """Fits the forest on the ``max_train`` distinct (id, quality) labels with the smallest hashes (all, if there are fewer).

    Only this sample, 12 bytes a label, is broadcast, and only its features, about
    100 bytes a label, come to the driver: of the texts of one id, the one with
    the smallest hash trains. Null ids, qualities and texts don't train.
    """
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    sample = smallest(stage_table(spark, sample.distinct(), "labels"), F.xxhash64("doc_id"), max_train)

    def work(batches):
        for batch in batches:
            for i, j, texts in text_slices(batch.column(3)):
                x = statistics(texts)[1]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:3]), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "h", "x"])

    joined = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), as_binary("text").alias("text"))
    found = joined.mapInArrow(work, "doc_id long, quality int, h long, x array<double>")
    rows = found.groupBy("doc_id", "quality").agg(F.min_by("x", "h").alias("x")).toArrow()
    if not rows.num_rows:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0), [d for _, d in FEATURES])
    order = np.lexsort((rows["quality"].to_numpy(), rows["doc_id"].to_numpy()))
    x = np.array(rows["x"].to_pylist())[order]
    y = rows["quality"].to_numpy()[order].astype(np.float64)
    return grow(x, y, [d for _, d in FEATURES])


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five base counts, base_failed, score, kept: one row for each row of ``docs``.

    The base fails texts of fewer than 20 words or with over 30% of words in
    repeated 8-word windows; of the rest, the forest keeps those of at least
    ``threshold`` probability. A null or empty text has no words and fails.
    Null ids are kept as null, repeated rows are scored alike, other columns are
    ignored, an empty table gives an empty result. With empty or one-sided labels
    the forest decides by the prior. A very long text is counted whole, with about
    60 bytes of arrays a byte in its worker.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    forest = train(spark, docs, labels, max_train)

    def work(batches):
        for batch in batches:
            for i, j, texts in text_slices(batch.column(1)):
                base, x = statistics(texts)
                p = forest.probability(x)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                cols = [batch.column(0).slice(i, j - i), *(pa.array(base[k], pa.int64()) for k in BASE), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "base_failed", "score", "kept"])

    return docs.select("doc_id", as_binary("text").alias("text")).mapInArrow(work, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean")
