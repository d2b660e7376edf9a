"""Bounds on what a Python worker holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send at most ``rows`` rows at once to Python: texts can be long, and a batch is held in memory whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
