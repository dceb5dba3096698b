"""A corpus pipeline: stages that filter documents, each written and reread by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm.common import WORD, stage_table, table
from hornbeam.llm.decontaminate import contaminated
from hornbeam.llm.line_dedup import remove_boilerplate
from hornbeam.llm.mixing import mix_sources
from hornbeam.llm.near_dup import near_duplicates, picked
from hornbeam.llm.quality import quality_rules


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number from the text's hash, above all usual ids, where doc_id is null, and the column that holds the ids as they were."""
    was = f"id_{uuid.uuid4().hex}"
    made = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    return docs.withColumn(was, F.col("doc_id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), made)), was


def _without(keyed: DataFrame, gone: DataFrame, was: str, columns: list[str]) -> DataFrame:
    """Documents whose key isn't in ``gone``, with their ids as they were."""
    left = picked(keyed, gone, "left_anti")
    return left.select([F.col(was).alias(c) if c == "doc_id" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, also those without an id."""
    keyed, was = _keyed(docs)
    verdicts = quality_rules(spark, keyed, table(spark, sf_dir, "labels"))
    gone = stage_table(spark, verdicts.filter("not kept").select("doc_id").distinct(), "rejected")
    return _without(keyed, gone, was, docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, but for their first occurrence; no document goes."""
    return remove_boilerplate(spark, docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; those without an id come after all others."""
    keyed, was = _keyed(docs)
    # Copies without an id have one key, so all but one go before the groups are made; texts without words are no copies.
    worded = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    copies = keyed.filter(F.col(was).isNull() & worded).dropDuplicates(["doc_id"])
    keyed = keyed.filter(F.col(was).isNotNull() | ~worded).union(stage_table(spark, copies, "copies"))
    gone = stage_table(spark, near_duplicates(spark, keyed).filter("not kept").select("doc_id").distinct(), "duplicates")
    return _without(keyed, gone, was, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, also those without an id."""
    keyed, was = _keyed(docs)
    found = contaminated(spark, keyed, table(spark, sf_dir, "benchmark"))
    gone = stage_table(spark, found.select("doc_id").distinct(), "contaminated")
    return _without(keyed, gone, was, docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per remaining document, the words that the mix takes of it."""
    return mix_sources(spark, docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix)]

#: Trees, sketches and template windows aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage_table(spark, docs, name)
    return docs
