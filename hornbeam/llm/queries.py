"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chat, line_dedup, warc
from .common import table
from .decontaminate import contaminated
from .kneser_ney import score_documents
from .line_dedup import remove_boilerplate
from .mixing import mix_sources
from .near_dup import near_duplicates
from .pii import personal_spans
from .quality import quality_rules
from .secret_scan import secret_spans


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, base counts, base_failed, score, kept."""
    return quality_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return mix_sources(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, and length and digest of the text that is left."""
    cleaned = remove_boilerplate(spark, table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("left_chars"), F.md5("text").alias("left_md5"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id, component_id, kept."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, by trigrams: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_documents(spark, table(spark, sf_dir, "documents"), order=3)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded."""
    return secret_spans(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    return personal_spans(spark, table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, read back from the formatted turns: counts and digests."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], given.schema)
    return chat.read_back(chat.format_turns(given.union(added)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the archives read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents and the benchmark items found in them: doc_id, item_id, matched_tokens, item_tokens."""
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_secret_scan": op6_secret_scan,
    "op7_pii": op7_pii,
    "op8_chat_format": op8_chat_format,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL,
    "op8_chat_format": chat.SQL,
    "op9_warc": warc.SQL,
}
