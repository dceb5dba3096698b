"""The stored relations: labels, edges, properties and plain relations as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import as_term


@dataclass
class Relation:
    """A DataFrame with columns c0, c1, ... and their kinds."""

    df: DataFrame
    kinds: list[str]

    @classmethod
    def of(cls, df: DataFrame, kinds: list[str]) -> Relation:
        return cls(df.toDF(*(f"c{i}" for i in range(len(kinds)))), kinds)


@dataclass
class Catalog:
    """Labels (id), edges (source, target, id), properties (entity, value) and relations by name and arity.

    Ids, labels and edge types are atoms. A property column keeps its native
    type and has one kind; mixed properties have tagged text and kind ``term``.
    """

    spark: SparkSession
    labels: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    properties: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    relations: dict[tuple[str, int], Relation] = field(default_factory=dict)

    def label(self, name: str, ids: DataFrame) -> Catalog:
        self.labels[name] = ids.toDF("id")
        return self

    def edge(self, kind: str, df: DataFrame) -> Catalog:
        """``df`` has source, target and, optionally, an id (by default source:type:target)."""
        if len(df.columns) == 2:
            df = df.toDF("source", "target").withColumn("id", F.concat_ws(":", "source", F.lit(kind), "target"))
        self.edges[kind] = df.toDF("source", "target", "id")
        return self

    def property(self, key: str, df: DataFrame, kind: str) -> Catalog:
        self.properties[key] = (df.toDF("entity", "value"), kind)
        return self

    def relation(self, name: str, df: DataFrame, kinds: list[str]) -> Catalog:
        self.relations[name, len(kinds)] = Relation.of(df, kinds)
        return self

    @classmethod
    def of_graph(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame, properties: DataFrame) -> Catalog:
        """A catalog over graph tables: nodes(id, labels), edges(id, edge_type, source, target), properties(entity, key, kind, text, number).

        Labels, types and keys are views that filter the tables, so the filter is
        pushed into the scan; their names are listed by one small aggregation.
        """
        out = cls(spark)
        exploded = nodes.select("id", F.explode("labels").alias("label"))
        for r in exploded.select("label").distinct().collect():
            out.label(r["label"], exploded.filter(F.col("label") == r["label"]).select("id"))
        for r in edges.select("edge_type").distinct().collect():
            out.edge(r["edge_type"], edges.filter(F.col("edge_type") == r["edge_type"]).select("source", "target", "id"))
        kinds: dict[str, set[str]] = {}
        for r in properties.select("key", "kind").distinct().collect():
            kinds.setdefault(r["key"], set()).add(r["kind"])
        for key, found in kinds.items():
            mine = properties.filter(F.col("key") == key)
            if len(found) == 1:
                kind = next(iter(found))
                value = F.col("number").cast("long") if kind == "int" else F.col("number") if kind == "float" else F.col("text")
            else:
                kind = "term"
                value = F.when(F.col("kind") == "int", F.concat(F.lit("$i:"), F.col("number").cast("long").cast("string"))).when(F.col("kind") == "float", F.concat(F.lit("$f:"), F.col("number").cast("string")))
                value = value.when(F.col("kind") == "str", F.concat(F.lit("$s:"), F.col("text"))).otherwise(F.concat(F.lit("$a:"), F.col("text")))
            out.property(key, mine.select("entity", value.alias("value")), kind)
        out.nodes_df = nodes
        return out

    def nodes(self) -> DataFrame | None:
        parts = list(self.labels.values())
        if getattr(self, "nodes_df", None) is not None:
            return self.nodes_df.select("id")
        return reduce(DataFrame.union, parts).distinct() if parts else None

    def all_edges(self, kind: str | None = None) -> DataFrame | None:
        """source, target, edge_type, id."""
        parts = [df.select("source", "target", F.lit(k).alias("edge_type"), "id") for k, df in self.edges.items() if kind in (None, k)]
        return reduce(DataFrame.union, parts) if parts else None

    def all_properties(self, key: str | None = None) -> DataFrame | None:
        """entity, key, value as tagged text."""
        parts = [df.select("entity", F.lit(k).alias("key"), as_term(F.col("value"), kind).alias("value")) for k, (df, kind) in self.properties.items() if key in (None, k)]
        return reduce(DataFrame.union, parts) if parts else None

    def find(self, name: str, arity: int, known: dict[int, str] | None = None) -> Relation | None:
        """The stored relation of a goal; ``known`` has the bound atom arguments, which pick a single view where they can."""
        known = known or {}
        if (name, arity) in self.relations:
            return self.relations[name, arity]
        if arity == 1:
            if name == "node":
                df = self.nodes()
                return Relation.of(df, ["atom"]) if df is not None else None
            return Relation.of(self.labels[name], ["atom"]) if name in self.labels else None
        if arity == 2:
            if name == "label":
                parts = [df.select("id", F.lit(k).alias("label")) for k, df in self.labels.items() if known.get(1) in (None, k)]
                return Relation.of(reduce(DataFrame.union, parts), ["atom", "atom"]) if parts else None
            if name.startswith("prop_") and name[5:] in self.properties:
                df, kind = self.properties[name[5:]]
                return Relation.of(df, ["atom", kind])
            return Relation.of(self.edges[name].select("source", "target"), ["atom", "atom"]) if name in self.edges else None
        if arity == 3 and name == "property":
            if 1 in known:
                if known[1] not in self.properties:
                    return None
                df, kind = self.properties[known[1]]
                return Relation.of(df.select("entity", F.lit(known[1]), "value"), ["atom", "atom", kind])
            df = self.all_properties()
            return Relation.of(df, ["atom", "atom", "term"]) if df is not None else None
        if arity == 3 and name == "edge":
            df = self.all_edges()
            return Relation.of(df.select("source", "target", "edge_type"), ["atom"] * 3) if df is not None else None
        if arity == 4 and name == "edge_id":
            df = self.all_edges(known.get(1))
            return Relation.of(df.select("source", "edge_type", "target", "id"), ["atom"] * 4) if df is not None else None
        return None
