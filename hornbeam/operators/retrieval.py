"""Hybrid retrieval: reciprocal rank fusion, time and graph filters, budgets and quality metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import ranked

RRF_K = 60


@dataclass(frozen=True)
class Budget:
    """Limits of a request, checked before it runs."""

    top_k: int = 10
    candidate_k: int = 256
    page_size: int = 64
    max_pages: int = 16
    max_answers: int = 10_000
    timeout_ms: int = 30_000

    def __post_init__(self):
        if self.top_k < 1 or self.candidate_k < self.top_k:
            raise ValueError("candidate_k must be at least top_k, and top_k at least 1")
        if self.page_size * self.max_pages < self.candidate_k:
            raise ValueError("pages must hold candidate_k candidates")
        if self.max_answers < self.top_k:
            raise ValueError("max_answers must be at least top_k")
        if not 1 <= self.timeout_ms <= 300_000:
            raise ValueError("a timeout is 1 to 300000 ms")


def fuse(rankings: dict[str, DataFrame], ident: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """ident, fused_score, and <name>_rank and <name>_score of each ranking (ident, score, rank).

    A document counts once a ranking, at its best rank; a repeated one still
    takes its place in the ranking.
    """
    out = None
    for name, r in rankings.items():
        best = r.groupBy(ident).agg(F.min("rank").alias(f"{name}_rank"), F.max("score").alias(f"{name}_score"))
        out = best if out is None else out.join(best, ident, "full")
    score = sum(F.coalesce(1.0 / (F.lit(float(k)) + F.col(f"{n}_rank")), F.lit(0.0)) for n in rankings)
    return out.withColumn("fused_score", score)


def filtered(fused: DataFrame, budget: Budget, valid: DataFrame | None = None, graph: DataFrame | None = None, ident: str = "doc_id") -> DataFrame:
    """The top k of a fused ranking that pass both filters (tables of allowed ids), with fused_rank.

    Candidates are the first candidate_k by fused score; only then do filters
    apply, time before graph, as a bounded budget demands.
    """
    out = ranked(fused, budget.candidate_k, "fused_score", ident).withColumnRenamed("rank", "fused_rank")
    for allowed in (valid, graph):
        if allowed is not None:
            out = out.join(allowed.select(ident).distinct(), ident, "left_semi")
    return out.orderBy("fused_rank").limit(budget.top_k)


def execution_stats(fused: DataFrame, budget: Budget, valid: DataFrame | None = None, graph: DataFrame | None = None, ident: str = "doc_id") -> DataFrame:
    """candidates, time_rejected, graph_rejected up to the last answer, answers, and exhausted."""
    c = ranked(fused, budget.candidate_k, "fused_score", ident)
    for name, allowed in (("time_ok", valid), ("graph_ok", graph)):
        c = c.withColumn(name, F.lit(True)) if allowed is None else c.join(allowed.select(ident).distinct().withColumn(name, F.lit(True)), ident, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    passed = F.col("time_ok") & F.col("graph_ok")
    so_far = F.sum(passed.cast("int")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    looked = c.withColumn("so_far", F.coalesce(so_far, F.lit(0))).filter(F.col("so_far") < budget.top_k)
    return looked.agg(
        F.count("*").alias("candidates"), F.count_if(~F.col("time_ok")).alias("time_rejected"), F.count_if(F.col("time_ok") & ~F.col("graph_ok")).alias("graph_rejected"), F.count_if(passed).alias("answers"), (F.count_if(passed) < budget.top_k).alias("exhausted")
    )


def by_entity(hits: DataFrame, entity: str = "entity") -> DataFrame:
    """The best-ranked hit of each entity."""
    return hits.withColumn("n", F.row_number().over(W.partitionBy(entity).orderBy("rank"))).filter("n = 1").drop("n")


def quality(results: DataFrame, judged: DataFrame, k: int = 10, recall_at: tuple[int, ...] = (10, 100)) -> DataFrame:
    """Means over judged queries of MRR, nDCG@k (gain 2^rel - 1) and recall.

    ``results`` has query_id, doc_id, rank; ``judged`` query_id, doc_id, rel. A
    query without results counts as zero.
    """
    good = judged.filter("rel > 0")
    hits = results.join(good, ["query_id", "doc_id"])
    gain = (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("rank") + 1)
    per = hits.groupBy("query_id").agg(F.max(1.0 / F.col("rank")).alias("mrr"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"), *(F.count_if(F.col("rank") <= n).alias(f"hits_{n}") for n in recall_at))
    ideal = good.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rel").desc(), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("idcg"), F.count("*").alias("relevant"))
    all_ = ideal.join(per, "query_id", "left").fillna(0.0)
    return all_.agg(F.count("*").alias("queries"), F.avg("mrr").alias("mrr"), F.avg(F.col("dcg") / F.col("idcg")).alias(f"ndcg_{k}"), *(F.avg(F.col(f"hits_{n}") / F.col("relevant")).alias(f"recall_{n}") for n in recall_at))
