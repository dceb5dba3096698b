"""Exact vector search with columns only: no vector leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ranked

NORM_TOLERANCE = 1e-4
#: Chunks of one source that are broadcast.
MOST_CHUNKS = 10_000


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), norm(a)))


def problems(vectors: DataFrame, dimension: int, normalized: bool = False, vector_col: str = "embedding") -> DataFrame:
    """The vectors that can't be searched, with ``problem``: dimension, finite, zero or norm."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    problem = F.when(v.isNull() | (F.size(v) != dimension), "dimension").when(odd, "finite").when(norm(v) == 0, "zero")
    if normalized:
        problem = problem.when(F.abs(norm(v) - 1) > NORM_TOLERANCE, "norm")
    return vectors.withColumn("problem", problem).filter("problem is not null")


def search(vectors: DataFrame, query: list[float], top_k: int | None = None, metric: str = "cosine", threshold: float | None = None, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """doc_id, score, rank by score, then id. The query is a constant of the plan; ``where`` filters before scoring."""
    if not query or not all(math.isfinite(x) for x in query):
        raise ValueError("a query vector needs finite values")
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")
    size = math.sqrt(sum(x * x for x in query))
    if metric == "cosine" and size == 0:
        raise ValueError("a query vector of length zero has no direction")
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(vector_col)
    rows = vectors if where is None else vectors.filter(where)
    rows = rows.filter(F.size(v) == len(query))
    score = F.try_divide(dot(v, q), norm(v) * size) if metric == "cosine" else dot(v, q)
    scored = rows.select(F.col(id_col).alias("doc_id"), score.alias("score")).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return ranked(scored, top_k)


def similar(vectors: DataFrame, source, entity_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.0) -> DataFrame:
    """entity, score of every other entity: the best over the chunks of both, at least ``threshold``.

    Every vector meets the source's chunks once; they are broadcast if, counted
    first, they are few.
    """
    mine = vectors.filter(F.col(entity_col) == source).select(F.col(vector_col).alias("q"))
    side = F.broadcast(mine) if mine.limit(MOST_CHUNKS + 1).count() <= MOST_CHUNKS else mine
    rows = vectors.filter(F.col(entity_col) != source).join(side, F.size(F.col(vector_col)) == F.size("q"))
    return rows.groupBy(F.col(entity_col).alias("entity")).agg(F.max(cosine(F.col(vector_col), F.col("q"))).alias("score")).filter(F.col("score") >= threshold)
