"""The streaming windows over the events table, as batch queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepared
from ..sources.files import parquet
from ..streaming import windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(prepared(spark), sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(_events(spark, sf_dir))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(_events(spark, sf_dir))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_tumbling": tumbling, "stream_sessions": sessions}

ORACLE = {
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 3) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS "end", COUNT(*) AS n FROM (
        SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT user_id, ts, event_id, CASE WHEN ts <= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
}
