"""Spark sessions with the settings the dialect's semantics need."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Names are case-insensitive, time is UTC, recursion goes as deep as the dialect allows.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_spark(app: str = "tarnwick", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | extra).getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """The given session with the settings that queries rely on."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
