"""Views and traversals of the stored graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.catalog import Catalog
from ..shared import stage_some, stage_table

MAX_DEPTH = 32


def edge_objects(edges: DataFrame):
    return F.struct("id", "edge_type", "source", "target")


def edge_lists(catalog: Catalog, end: str, node: str | None, kind: str | None, bound: bool = True) -> DataFrame:
    """id, edge_type, edges (JSON text): one row a node with the sorted list of its edges, or, unbound, one row an edge."""
    edges = catalog.all_edges(kind)
    if not bound:
        return edges.select(F.col(end).alias("id"), "edge_type", F.to_json(F.struct("id", "edge_type", "source", "target")).alias("edges"))
    if node is not None:
        mine = edges.filter(F.col(end) == node)
        return mine.agg(F.to_json(F.array_sort(F.collect_list(edge_objects(edges)))).alias("edges")).select(F.lit(node).alias("id"), F.lit(kind).alias("edge_type"), "edges")
    return edges.groupBy(F.col(end).alias("id")).agg(F.to_json(F.array_sort(F.collect_list(edge_objects(edges)))).alias("edges")).select("id", F.lit(kind).alias("edge_type"), "edges")


def node_views(catalog: Catalog, node: str | None = None) -> DataFrame:
    """id, labels, properties, out_edges, in_edges of every node, or of one."""
    pick = (lambda df, c: df.filter(F.col(c) == node)) if node is not None else (lambda df, c: df)
    out = pick(catalog.nodes(), "id")
    labels = catalog.find("label", 2)
    if labels is not None:
        out = out.join(pick(labels.df, "c0").groupBy(F.col("c0").alias("id")).agg(F.array_sort(F.collect_set("c1")).alias("labels")), "id", "left")
    props = catalog.all_properties()
    if props is not None:
        values = F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", F.regexp_replace("value", r"^\$[asif]:", "").alias("value")))))
        one = pick(props, "entity").groupBy(F.col("entity").alias("id"), "key").agg(F.max("value").alias("value"))
        out = out.join(one.groupBy("id").agg(values.alias("properties")), "id", "left")
    edges = catalog.all_edges()
    for name, end in (("out_edges", "source"), ("in_edges", "target")):
        if edges is not None:
            out = out.join(pick(edges, end).groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_list(edge_objects(edges))).alias(name)), "id", "left")
    for name, empty in (("labels", "array<string>"), ("properties", "map<string,string>"), ("out_edges", "array<struct<id:string,edge_type:string,source:string,target:string>>"), ("in_edges", "array<struct<id:string,edge_type:string,source:string,target:string>>")):
        blank = F.create_map().cast(empty) if empty.startswith("map") else F.array().cast(empty)
        out = out.withColumn(name, F.coalesce(F.col(name), blank) if name in out.columns else blank)
    return out.select("id", "labels", "properties", "out_edges", "in_edges")


def reachable_from(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """source, target, depth: nodes reached over outgoing edges in at most ``depth`` steps, without the start itself.

    Breadth first: each round joins the last frontier to the edges and drops,
    by an anti join, what was reached before; rounds are written tables. While
    the frontier is small its file size says so, and it is sent to the edges, of
    which nothing is shuffled.
    """
    pairs = stage_table(spark, edges.select("source", "target"), "pairs")
    frontier = starts.select(F.col("id").alias("source"), F.col("id").alias("target"))
    seen: list[DataFrame] = []
    for d in range(1, depth + 1):
        step = frontier.select("source", F.col("target").alias("via")).join(pairs.select(F.col("source").alias("via"), "target"), "via").select("source", "target").filter("source <> target").distinct()
        if seen:
            step = step.join(reduce(DataFrame.unionAll, seen).select("source", "target"), ["source", "target"], "left_anti")
        frontier = stage_some(spark, step.withColumn("depth", F.lit(d)), "frontier")
        if frontier is None:
            break
        seen.append(frontier)
        if len(seen) > 12:
            seen = [stage_table(spark, reduce(DataFrame.unionAll, seen), "reached")]
    return reduce(DataFrame.unionAll, seen) if seen else spark.createDataFrame([], "source string, target string, depth int")


def shortest_paths(spark: SparkSession, edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, target: str | None = None) -> DataFrame:
    """source, target, path (array of nodes, both ends included), one a pair; with a ``target`` and one start the search ends where it is reached.

    Of several shortest paths that one is kept which a queue would find first:
    nodes are visited in the order of discovery, their edges by type, then target.
    """
    order = stage_table(spark, edges.select("source", "target", "edge_type"), "pairs")
    frontier = starts.select(F.col("id").alias("source"), F.col("id").alias("target"), F.array("id").alias("path"), F.array().cast("array<string>").alias("rank"))
    seen: list[DataFrame] = []
    for _ in range(depth):
        step = frontier.select("source", F.col("target").alias("via"), "path", "rank").join(order.select(F.col("source").alias("via"), "target", "edge_type"), "via").filter("source <> target")
        step = step.select("source", "target", F.concat("path", F.array("target")).alias("path"), F.concat("rank", F.array("edge_type", "target")).alias("rank"))
        step = step.withColumn("n", F.row_number().over(W.partitionBy("source", "target").orderBy("rank"))).filter("n = 1").drop("n")
        if seen:
            step = step.join(reduce(DataFrame.unionAll, seen).select("source", "target"), ["source", "target"], "left_anti")
        frontier = stage_some(spark, step, "paths")
        if frontier is None:
            break
        seen.append(frontier)
        if target is not None and not frontier.filter(F.col("target") == target).isEmpty():
            break
        if len(seen) > 12:
            seen = [stage_table(spark, reduce(DataFrame.unionAll, seen), "reached")]
    return reduce(DataFrame.unionAll, seen).select("source", "target", "path") if seen else spark.createDataFrame([], "source string, target string, path array<string>")
