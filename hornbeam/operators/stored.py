"""Tables that change by commits: segments of rows, later ones replacing the keys of earlier ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of replaced keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Tasks a slice in which partitioned rows are written.
SLICE_TASKS = 16
#: More segments than this are merged by the next commit.
MOST_SEGMENTS = 16


class Log:
    """Numbered commits in a folder that all executors share; each is one small JSON file that is created once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda p: hadoop(p)
        self._fs = hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._at(self.path)))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, n: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/{n:012d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The number and content of the last commit; (0, {}) before the first."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def append(self, n: int, content: dict) -> None:
        """Commit ``n`` appears whole: it is written under another name, then renamed; a number that is taken is an error."""
        final, part = self._at(f"{self.path}/{n:012d}.json"), self._at(f"{self.path}/.{n:012d}.part")
        if self._fs.exists(final):
            raise ValueError(f"{self.path} has commit {n} already")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if not self._fs.rename(part, final):
            raise ValueError(f"{self.path} has commit {n} already")

    def keep_last(self, n: int) -> None:
        """Forgets all commits but the last ``n``."""
        for x in self.numbers()[:-n]:
            self._fs.delete(self._at(f"{self.path}/{x:012d}.json"), False)

    def remove(self, path: str) -> None:
        self._fs.delete(self._at(path), True)


class KeyedTable:
    """A table in a folder. A commit puts rows and drops keys in one step; readers see the last commit.

    Each commit writes one segment: its rows, and the keys whose earlier rows end
    with it. Reading is an anti join with the ended keys, broadcast while they
    are few; after MOST_SEGMENTS the segments are merged into one. A commit that
    fails, or loses executors on the way, leaves files that no commit names.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], partition: list[str] | None = None, sort: list[str] | None = None):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.partition, self.sort, self.log = partition or [], sort or [], Log(spark, f"{path.rstrip('/')}/log")

    @property
    def _state(self) -> dict:
        return self.log.last()[1] or {"segments": [], "ended": 0, "facts": {}}

    @property
    def facts(self) -> dict:
        """What the last commit says besides its segments."""
        return self._state["facts"]

    def _rows(self, segments: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{s}/rows").withColumn("segment_no", F.lit(i)) for i, s in enumerate(segments)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self, where=None) -> DataFrame:
        """The rows as of the last commit; ``where`` reaches the scans of all segments."""
        state = self._state
        segments = state["segments"]
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        rows = self._rows(segments)
        rows = rows if where is None else rows.filter(where)
        if len(segments) > 1 and state["ended"]:
            keys = self.spark.read.parquet(*(f"{self.path}/{s}/keys" for s in segments[1:]))
            order = F.create_map(*(F.lit(x) for i, s in enumerate(segments) for x in (s, i)))
            ended = keys.groupBy(*self.key).agg(F.max(order[F.col("segment")]).alias("ends_at"))
            ended = F.broadcast(ended) if state["ended"] <= BROADCAST_KEYS else ended
            ended = ended.select(*(F.col(k).alias(f"ended_{k}") for k in self.key), "ends_at")
            rows = rows.join(ended, [*(F.col(k).eqNullSafe(F.col(f"ended_{k}")) for k in self.key), F.col("segment_no") < F.col("ends_at")], "left_anti")
        return rows.drop("segment_no")

    def commit(self, rows: DataFrame, ended: DataFrame | None = None, facts: dict | None = None, slices: int = 1) -> int:
        """Puts ``rows``, whose keys replace earlier rows of the same keys, and ends the keys in ``ended``; each partition is written by ``slices`` tasks."""
        n, _ = self.log.last()
        state = self._state
        if len(state["segments"]) >= MOST_SEGMENTS:
            self.compact()
            n, _ = self.log.last()
            state = self._state
        name = f"segment-{n + 1:012d}"
        self._write(rows, name, slices)
        keys = rows.sparkSession.read.schema(self.schema).parquet(f"{self.path}/{name}/rows").select(*self.key)
        keys = keys.unionByName(ended.select(*self.key)) if ended is not None else keys
        keys.distinct().withColumn("segment", F.lit(name)).write.mode("overwrite").parquet(f"{self.path}/{name}/keys")
        more = self.spark.read.parquet(f"{self.path}/{name}/keys").count() if state["segments"] else 0
        self.log.append(n + 1, {"segments": [*state["segments"], name], "ended": state["ended"] + more, "slices": state.get("slices", 0) + slices, "facts": {**state["facts"], **(facts or {})}})
        return n + 1

    def _write(self, rows: DataFrame, name: str, slices: int = 1) -> None:
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns)
        if self.partition and slices > 1:
            # Some slices share a task; so many tasks that few share one.
            rows = rows.repartition(SLICE_TASKS * slices, *self.partition, F.pmod(F.xxhash64(*self.key), F.lit(slices)))
        elif self.partition:
            rows = rows.repartition(*self.partition)
        if self.sort:
            rows = rows.sortWithinPartitions(*self.partition, *self.sort)
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*self.partition) if self.partition else writer).parquet(f"{self.path}/{name}/rows")

    def compact(self) -> int:
        """Merges all segments into one; what they had is removed by ``vacuum``."""
        n, _ = self.log.last()
        state = self._state
        name = f"segment-{n + 1:012d}"
        slices = max(1, state.get("slices", 1))
        self._write(self.read(), name, slices)
        self.log.append(n + 1, {"segments": [name], "ended": 0, "slices": slices, "facts": state["facts"]})
        return n + 1

    def vacuum(self) -> None:
        """Removes the folders that the last commit doesn't name."""
        kept = set(self._state["segments"])
        fs, at = self.log._fs, self.log._at
        for f in fs.listStatus(at(self.path)):
            name = f.getPath().getName()
            if name.startswith("segment-") and name not in kept:
                fs.delete(f.getPath(), True)
        self.log.keep_last(1)
