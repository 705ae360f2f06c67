"""Session defaults for tests and local runs; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "quarrymill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time zone, ANSI mode and adaptive execution on."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, unless their path has it already. Once a Spark context."""
    import shutil
    import tempfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quarrymill_shipped", False):
        return
    with tempfile.TemporaryDirectory() as tmp:
        source = shutil.copytree(root / "quarrymill", Path(tmp) / "src" / "quarrymill", ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="quarrymill-")) / "quarrymill"), "zip", source.parent)
    context.addPyFile(made)
    context._quarrymill_shipped = True
