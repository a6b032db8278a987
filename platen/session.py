"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "platen", **settings: str) -> SparkSession:
    """UTC days, adaptive execution, Arrow batches; further settings by their full names."""
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=own | settings).getOrCreate()
