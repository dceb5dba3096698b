"""Graphs kept in a folder, a version a commit."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import history, mutate
from .stored import KeyedTable, Log


class GraphStore:
    """Nodes, edges, outbox and history as keyed tables: a batch writes the rows that it changed, not the graph.

    The outbox comes last: events are there only when what they tell of is, and
    a batch that was cut off before it is written again by its caller.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.nodes = KeyedTable(spark, f"{path}/nodes", mutate.NODES, ["id"])
        self.edges = KeyedTable(spark, f"{path}/edges", mutate.EDGES, ["id"])
        self.outbox = KeyedTable(spark, f"{path}/outbox", mutate.OUTBOX, ["sequence"])
        self.history = KeyedTable(spark, f"{path}/history", history.HISTORY, ["id", "valid_from", "version"])
        self.raw = KeyedTable(spark, f"{path}/raw", "namespace string, key string, value string", ["namespace", "key"])
        self.log = Log(spark, f"{path}/graph")

    def read(self) -> mutate.Graph:
        return mutate.Graph(self.nodes.read(), self.edges.read(), self.outbox.read())

    def write(self, after: mutate.Graph, at=None) -> int:
        """Commits what differs from the stored graph; returns the last sequence number."""
        before = self.read()
        same = ["id", "version"]
        when = F.current_timestamp() if at is None else at
        self.history.commit(history.recorded(self.history.read().limit(0), before, after, when))
        for table, old, new in ((self.nodes, before.nodes, after.nodes), (self.edges, before.edges, after.edges)):
            table.commit(new.join(old.select(*same), same, "left_anti"), old.join(new.select("id"), "id", "left_anti").select("id"))
        self.outbox.commit(after.outbox.join(before.outbox.select("sequence"), "sequence", "left_anti"))
        last = self.outbox.read().agg(F.max("sequence").alias("m")).first()["m"] or 0
        self.log.append(self.log.last()[0] + 1, {"sequence": last})
        return last

    def put_raw(self, namespace: str, rows: list[tuple[str, str | None]]) -> int:
        """Puts (key, value) pairs of a namespace, those without a value being removed, together with one outbox event."""
        put = self.spark.createDataFrame([(namespace, k, v) for k, v in rows if v is not None], "namespace string, key string, value string")
        gone = self.spark.createDataFrame([(namespace, k) for k, v in rows if v is None], "namespace string, key string")
        self.raw.commit(put, gone)
        last = (self.outbox.read().agg(F.max("sequence").alias("m")).first()["m"] or 0) + 1
        self.outbox.commit(self.spark.createDataFrame([(last, "projection", namespace, last, "upsert", sorted(k for k, _ in rows))], mutate.OUTBOX))
        return last

    def get_raw(self, namespace: str, key: str) -> str | None:
        rows = self.raw.read((F.col("namespace") == namespace) & (F.col("key") == key)).collect()
        return rows[0]["value"] if rows else None

    def scan_prefix(self, namespace: str, prefix: str):
        """The (key, value) pairs of a namespace whose key begins with a prefix, in order."""
        return mutate.with_prefix(self.raw.read(F.col("namespace") == namespace).select("key", "value"), prefix, "key")
