"""The folder that all executors share, tables written there, and shipping of this package to Python workers."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session leaves it unset is a folder of our own made; on
    a cluster a missing setting is an error, since no machine-local folder may
    stand in for it.
    """
    set_by = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not set_by and sc._jsc.sc().getCheckpointDir().isDefined():
        set_by = sc._jsc.sc().getCheckpointDir().get()
    if not set_by:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_by = "file://" + tempfile.mkdtemp(prefix="hornbeam-")
        spark.conf.set("spark.checkpoint.dir", set_by)
        _forget_at_exit(spark, set_by)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(set_by)
    return set_by


def _forget_at_exit(spark: SparkSession, uri: str) -> None:
    def drop() -> None:
        try:
            remove(spark, uri)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(drop)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of ours from the shared file system."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(sc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, tag: str) -> str:
    """The URI of a folder of ours in the shared folder, deleted when the application ends."""
    uri = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    _forget_at_exit(spark, uri)
    return uri


def local_path(uri: str) -> str:
    """The POSIX path under which every worker sees a shared folder.

    Memory-mapped files need one; a folder that is only reachable through an
    object-store or HDFS client is refused.
    """
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parts.path


def stage_table(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    schema = df.schema
    uri = new_folder(spark, tag)
    df.write.parquet(uri)
    return spark.read.schema(schema).parquet(uri)


def stage_some(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame | None:
    """As ``stage_table``, but None if there are no rows, which the writing job itself tells."""
    seen = Observation()
    schema = df.schema
    uri = new_folder(spark, tag)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(uri)
    return spark.read.schema(schema).parquet(uri) if seen.get["n"] else None


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: where their path lacks it, a zip of it is sent along with the application's files."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted((root / "hornbeam").rglob("*.py")):
            z.write(p, p.relative_to(root))
    # Through the shared file system's client, which may be an object store's.
    uri = f"{new_folder(spark, 'code')}/hornbeam_code.zip"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(held.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(uri)
