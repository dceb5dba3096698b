"""Text analysis, chunking and BM25 retrieval.

BM25 is two aggregations and a join: postings (document, term, tf) and corpus
statistics. Only documents that hold a query term are scored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import ship, stage_table

K1, B = 1.2, 0.75
#: Words of letters and digits; a CJK character is a token of its own, in place of a dictionary.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"


def terms(text: Column) -> Column:
    """Lower-cased tokens of a text, in order; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


_HAN = re.compile(r"[\u3400-\u9fff]+")


def segmented(text: str, words: frozenset[str], longest: int) -> list[str]:
    """Lower-cased tokens with runs of Han characters cut by a dictionary: the longest word at each place, else one character."""
    out: list[str] = []
    for m in re.finditer(r"[\u3400-\u9fff]+|[\u3040-\u30ff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+", text.lower()):
        run = m[0]
        if not _HAN.fullmatch(run):
            out.append(run)
            continue
        i = 0
        while i < len(run):
            n = next((n for n in range(min(longest, len(run) - i), 1, -1) if run[i : i + n] in words), 1)
            out.append(run[i : i + n])
            i += n
    return out


def dictionary_terms(words: list[str]):
    """A function of a text column like ``terms``, for a dictionary of Han words, which is sent to the tasks (its size is the caller's to bound)."""
    known, longest = frozenset(w.lower() for w in words), max(map(len, words), default=1)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else segmented(t, known, longest))

    return cut


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, dl, term, tf."""
    t = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col)).alias("t"))
    return t.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n documents and their average length in terms."""
    return docs.select(F.size(terms(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(query: str) -> list[str]:
    """Distinct query terms; the driver-side twin of ``terms``."""
    out = re.findall(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+", query.lower())
    return list(dict.fromkeys(out))


def bm25_explain(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", weight: float = 1.0, where: Column | None = None, narrowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, term, tf, df, idf, dl, avgdl, weight, score of each query term in each document.

    Statistics are the whole corpus's; ``where`` filters the documents that are
    scored, ``narrowed`` their hits. Documents are read and tokenised once: each
    scan task keeps the few query terms of a document as one array beside its
    length, and only that written table is aggregated. Where searches are many,
    ``TextIndex`` keeps all postings.
    """
    wanted = query_terms(query)
    t = terms(F.col(text_col))
    ok = where if where is not None else F.lit(True)
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    counts = F.array(*(times(w) for w in wanted)) if wanted else F.array().cast("array<int>")
    scanned = docs.select(F.col(id_col).alias("doc_id"), t.alias("t"), ok.alias("ok")).select("doc_id", "ok", F.size("t").alias("dl"), counts.alias("tfs"))
    scanned = stage_table(docs.sparkSession, scanned, "hits")
    held = lambda i: F.count_if(F.get("tfs", F.lit(i)) > 0).alias(f"df{i}")
    facts = scanned.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(held(i) for i in range(len(wanted)))).first()
    n, avgdl = facts["n"], facts["avgdl"] or 0.0
    rows = scanned.filter("ok").filter(F.exists("tfs", lambda x: x > 0))
    rows = rows if narrowed is None else narrowed(rows)
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.get("tfs", F.lit(i)).cast("long").alias("tf"), F.lit(facts[f"df{i}"]).cast("long").alias("df")) for i, w in enumerate(wanted)))) if wanted else F.explode(F.array().cast("array<struct<term:string,tf:bigint,df:bigint>>"))
    rows = rows.select("doc_id", "dl", each.alias("x")).select("doc_id", "x.term", "x.tf", "x.df", "dl").filter("tf > 0")
    rows = rows.withColumn("avgdl", F.lit(float(avgdl))).withColumn("idf", idf(F.lit(n).cast("long"), F.col("df"))).withColumn("weight", F.lit(float(weight)))
    return rows.withColumn("score", F.col("idf") * term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("weight"))).select("doc_id", "term", "tf", "df", "idf", "dl", "avgdl", "weight", "score")


def bm25(docs: DataFrame, query: str, top_k: int | None = None, id_col: str = "doc_id", text_col: str = "text", weight: float = 1.0, where: Column | None = None) -> DataFrame:
    """doc_id, score, rank by score, then id; ``top_k`` of them or all."""
    scored = bm25_explain(docs, query, id_col, text_col, weight, where).groupBy("doc_id").agg(F.sum("score").alias("score"))
    return ranked(scored, top_k)


def ranked(scored: DataFrame, top_k: int | None, by: str = "score", ident: str = "doc_id") -> DataFrame:
    """With ``rank``, a position by score, then id. A top k is taken without sorting the rest."""
    order = [F.col(by).desc(), F.col(ident)]
    if top_k is not None:
        scored = scored.orderBy(*order).limit(top_k)
    return scored.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def page(scored: DataFrame, offset: int, size: int, candidate_limit: int, by: str = "score", ident: str = "doc_id") -> DataFrame:
    """One page of a ranking, with next_offset (null at its end) and exhausted."""
    probe = min(offset + size + 1, candidate_limit)
    top = ranked(scored, probe, by, ident)
    more = F.max("rank").over(W.partitionBy()) > offset + size
    return top.withColumn("exhausted", ~more).withColumn("next_offset", F.when(more, F.lit(offset + size))).filter((F.col("rank") > offset) & (F.col("rank") <= offset + size))


@dataclass(frozen=True)
class Chunk:
    chunk_id: str
    ordinal: int
    start: int
    end: int
    content: str
    fingerprint: str


def _chunk(ordinal: int, data: bytes, a: int, b: int) -> Chunk:
    text = data[a:b].decode()
    digest = hashlib.sha256(text.encode()).hexdigest()
    return Chunk(f"{ordinal}-{digest[:16]}", ordinal, a, b, text, digest)


def whole_field(text: str) -> list[Chunk]:
    data = text.encode()
    return [_chunk(0, data, 0, len(data))] if text.strip() else []


def paragraphs(text: str) -> list[Chunk]:
    """Chunks end at blank lines and before and after heading lines; ranges are UTF-8 bytes without outer white space."""
    data = text.encode()
    spans: list[list[int]] = []
    at, open_ = 0, False
    for line in data.splitlines(keepends=True):
        body = line.strip()
        if not body:
            open_ = False
        elif body.startswith(b"#"):
            spans.append([at, at + len(line)])
            open_ = False
        elif open_:
            spans[-1][1] = at + len(line)
        else:
            spans.append([at, at + len(line)])
            open_ = True
        at += len(line)
    out = []
    for a, b in spans:
        raw = data[a:b]
        a, b = a + len(raw) - len(raw.lstrip()), b - len(raw) + len(raw.rstrip())
        out.append(_chunk(len(out), data, a, b))
    return out


def token_windows(text: str, size: int, overlap: int = 0) -> list[Chunk]:
    """Windows of ``size`` tokens, each an ASCII word or one other character, the next starting ``overlap`` tokens before the end."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a window needs a size of at least 1 and a smaller overlap")
    data = text.encode()
    tokens = [m.span() for m in re.finditer(rb"[0-9A-Za-z_]+|[\xc2-\xf4][\x80-\xbf]+", data)]
    out: list[Chunk] = []
    for i in range(0, len(tokens), size - overlap):
        part = tokens[i : i + size]
        out.append(_chunk(len(out), data, part[0][0], part[-1][1]))
        if i + size >= len(tokens):
            break
    return out


CHUNKERS = {"whole": whole_field, "paragraph": paragraphs}
#: Bytes of text, and of chunks, that a worker holds as Python objects at once.
CHUNK_BYTES = 2 << 20


def chunk_slices(batches, f: Callable[[str], list[Chunk]], most: int | None = None):
    """The chunks of (key, text) batches as batches of about ``most`` bytes, whatever the batches that come in have."""
    most = most or CHUNK_BYTES
    names, kinds = ["chunk_id", "ordinal", "start", "end", "content", "fingerprint"], [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        keys, texts, held, at, size = batch.column(0), batch.column(1), [], [], 0

        def made():
            columns = [pa.array([getattr(c, n) for c in held], k) for n, k in zip(names, kinds)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *columns], ["doc_id", *names])

        for i in range(batch.num_rows):
            text = texts[i].as_py()
            for c in f(text) if text is not None else []:
                held.append(c)
                at.append(i)
                size += len(c.content) + 200
                if size > most:
                    yield made()
                    held, at, size = [], [], 0
        if held:
            yield made()


def chunked(docs: DataFrame, how: str = "paragraph", id_col: str = "doc_id", text_col: str = "text", size: int = 200, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_id, ordinal, start, end, content, fingerprint; an Arrow function, since chunks are cut by a small state machine."""
    ship(docs.sparkSession)
    f = (lambda t: token_windows(t, size, overlap)) if how == "window" else CHUNKERS[how]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: chunk_slices(batches, f), f"doc_id {kind}, chunk_id string, ordinal int, start int, end int, content string, fingerprint string")
