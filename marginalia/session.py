"""Session helper used by tests, the benchmark and interactive work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "marginalia", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MARGINALIA_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
