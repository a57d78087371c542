"""Session builder with the engine's settings; on a cluster, sizes come from the cluster's own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lexloom", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew handling, and whatever ``conf`` adds."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
