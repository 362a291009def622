"""Event-time helpers, in batch over the events table (the same plans run on streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.queries import query, table
from millrace.streaming import events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = events.tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND THEN 1 ELSE 0 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid
""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = events.sessions(table(spark, sf, "events"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
