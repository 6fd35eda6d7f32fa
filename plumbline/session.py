"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "plumbline", **conf: str) -> SparkSession:
    """The running session, or one with adaptive execution (skewed joins split), UTC and Arrow; ``conf`` goes on top."""
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()
