"""Versions of nodes over time: an append-only table that as-of reads fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .mutate import Graph

HISTORY = "id string, version long, labels array<string>, properties map<string,string>, valid_from timestamp, gone boolean"


def recorded(history: DataFrame, before: Graph, after: Graph, at: Column) -> DataFrame:
    """The history with the versions that are in ``after`` only, and an end of the nodes that are in ``before`` only, as of a time."""
    new = after.nodes.join(before.nodes.select("id", "version"), ["id", "version"], "left_anti").select("id", "version", "labels", "properties", at.alias("valid_from"), F.lit(False).alias("gone"))
    gone = before.nodes.join(after.nodes.select("id"), "id", "left_anti").select("id", (F.col("version") + 1).alias("version"), "labels", "properties", at.alias("valid_from"), F.lit(True).alias("gone"))
    return history.unionByName(new).unionByName(gone)


def node_versions(history: DataFrame, ident: str | None = None) -> DataFrame:
    """id, version, labels, properties, valid_from, valid_to of one node, or of all, by ascending version; the last is open."""
    rows = history if ident is None else history.filter(F.col("id") == ident)
    # A node that is made again after its end begins with version 1 again, so time comes first.
    ends = F.lead("valid_from").over(W.partitionBy("id").orderBy("valid_from", "version"))
    return rows.withColumn("valid_to", ends).filter("not gone").select("id", "version", "labels", "properties", "valid_from", "valid_to").orderBy("id", "valid_from", "version")


def nodes_at(history: DataFrame, when: Column, ident: str | None = None) -> DataFrame:
    """id, labels, properties, version of all nodes (or one) as they were: the latest version that began by then, unless the node had ended.

    One aggregation with a partial maximum; no versions of a node are gathered.
    """
    rows = (history if ident is None else history.filter(F.col("id") == ident)).filter(F.col("valid_from") <= when)
    last = rows.groupBy("id").agg(F.max_by(F.struct("labels", "properties", "version", "gone"), F.struct("valid_from", "version")).alias("v"))
    return last.filter("not v.gone").select("id", "v.labels", "v.properties", "v.version")
