"""Session defaults shared by the tests, the bench and the examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "loomwork", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
