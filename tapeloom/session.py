"""The session settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "tapeloom", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's settings hold instead."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TAPELOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
