"""Runs that go on where they ended: by key against an append-only log, or by a stream's checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.operators.relational import pending
from quarrymill.scratch import discard, scratch_path


def append_missing(records: DataFrame, log: str, keys: list[str], step: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Run step over records that the log lacks, append, and return the log. force: start anew."""
    spark = records.sparkSession
    if force:
        discard(spark, log)
    done = read_log(spark, log)
    todo = records if done is None else pending(records, done, keys)
    step(todo).write.mode("append").parquet(log)
    return spark.read.parquet(log)


def read_log(spark: SparkSession, log: str) -> DataFrame | None:
    """The log, or None if there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(log) if system.exists(path) else None


def frozen_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Keep a run's settings beside its log; a later run with others must not go on."""
    shown = json.dumps(settings, sort_keys=True)
    kept = read_log(spark, path)
    if kept is None:
        spark.createDataFrame([(shown,)], "settings string").coalesce(1).write.parquet(path)
    elif (was := kept.first().settings) != shown:
        raise ValueError(f"the log was written with other settings: {was}")


def run_available(spark: SparkSession, source: str, step: Callable[[DataFrame], DataFrame], runs: int = 1, files_per_batch: int = 1) -> DataFrame:
    """Read what there is of a Parquet source as a stream, through step, into a log; every run goes on from the checkpoint."""
    base = scratch_path(spark, "stream")
    schema = spark.read.parquet(source).schema
    # a stream's source is a folder or a pattern
    pattern = source if source.endswith("/") else source[: -len(".parquet")] + "*.parquet"
    for _ in range(runs):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
        query = step(stream).writeStream.format("parquet").option("path", f"{base}/log").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{base}/log")


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Tumbling windows of events by type, with a watermark when streamed."""
    from pyspark.sql import functions as F

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
