"""A session with the settings that the library's semantics assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str = "local[*]", name: str = "noteloom", **conf) -> SparkSession:
    """A session: UTC, adaptive plans, skew joins split, Arrow on. Partition counts are left to the cluster's settings."""
    b = SparkSession.builder.master(master).appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return b.config(map={**base, **conf}).getOrCreate()
