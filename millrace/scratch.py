"""Intermediate tables in the folder that every executor sees.

``spark.checkpoint.dir`` names it.  Where that is unset a temporary folder is
used on a local master only; on a cluster each executor would write to its own
disk, so there it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        at = _local[app]
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes ``path``; a session that is gone leaves it to the folder's retention."""
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the latest when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and
    a lost executor costs only the running stage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found._scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            remove(df.sparkSession, path)
