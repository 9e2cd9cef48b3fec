"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """The active or a new session; ``settings`` override the defaults."""
    builder = SparkSession.builder.appName("inkwell").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
