"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, but on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrymill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quarrymill/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # the shared folder holds it, and it is read once or twice
    # what was shuffled for it is not needed again: let Spark's cleaner see that now, not when the heap is full
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def settle(make: Callable[[], DataFrame], name: str = "cut") -> DataFrame:
    """make() written and read back as by materialize(); what was written on the way to it is removed."""
    before = set(_written)
    out = materialize(make(), name)
    for path in set(_written) - before - {out._scratch_path}:
        discard(_written.pop(path), path)
    return out


def forget(table: DataFrame) -> None:
    """Remove a materialized table that nothing will read again."""
    path = table._scratch_path
    discard(_written.pop(path), path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch path with the file system that it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            discard(spark, path)
        except Exception:  # the session has ended; the folder's owner removes it
            return
