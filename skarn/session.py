"""Session with the settings that the engine's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """UTC, adaptive execution; everything else is left to the cluster."""
    builder = SparkSession.builder.appName("skarn").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[8]").config("spark.driver.memory", os.environ.get("SKARN_DRIVER_MEMORY", "8g"))
    return builder.getOrCreate()
