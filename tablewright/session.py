"""Session helper for tests, the benchmark and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = 8, app: str = "tablewright") -> SparkSession:
    """A local session. On a cluster, pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
