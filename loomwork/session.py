"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "loomwork", partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution with skew handling; `partitions` only where the input's size is known to be small."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
