"""Helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import local_path, new_folder, remove, shared_dir, ship, stage_table

__all__ = ["BROADCAST_ROWS", "WORD", "as_binary", "local_path", "new_folder", "remove", "shared_dir", "ship", "small", "smallest", "stage_table", "table"]

#: Words are maximal runs of characters other than ASCII white space; bytes.split() cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a few numbers up to this count are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcasting if its rows, counted first, are few."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def smallest(df: DataFrame, h: Column, most: int, n: int | None = None) -> DataFrame:
    """About the ``most`` rows with the smallest hashes ``h``, in that order, all if there are fewer.

    A bound on the hash, from the number of rows, keeps each task from sending
    ``most`` rows of its own to the driver.
    """
    n = df.count() if n is None else n
    if n > 2 * most:
        df = df.filter(h <= F.lit(int(1.3 * most / n * 2**64) - 2**63))
    return df.orderBy(h, *df.columns).limit(most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_binary(col: str):
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))
