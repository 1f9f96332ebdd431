"""Streams over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.sources.scratch import scratch
from lakewright.sources.tables import table
from lakewright.streaming import feeds

from .registry import query


def events(spark: SparkSession, d: str) -> DataFrame:
    # A stream reads folders or patterns; this one matches the one table.
    rows = feeds.read_files(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "ts", "event_id", "event_type")
    return feeds.latest_wins(spark, rows, scratch(spark, "latest"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def stream_once_per_day(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "daily")
    feeds.append(feeds.once_per_day(events(spark, d), ["user_id"], "ts").select("user_id", "day"), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema("user_id long, day date").parquet(f"{root}/rows").select("user_id", F.col("day").cast("string").alias("day"))


@query("""
SELECT CAST(day AS VARCHAR) AS day, event_type, n FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has passed."""
    root = scratch(spark, "counts")
    feeds.append(feeds.daily_counts(events(spark, d), ["event_type"], "ts"), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema("day date, event_type string, n long").parquet(f"{root}/rows").select(F.col("day").cast("string").alias("day"), "event_type", "n")
