"""Streaming queries: tables replayed as streams, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.context import messages
from palimpsest.plans.registry import query, table
from palimpsest.streaming import windows as S


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, as a stream in complete mode."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.finished(S.tumbling(S.replayed(e, "events"), "ts", "1 hour", "10 minutes", "event_type"), "tumbling", "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with pauses below half an hour, as a stream in complete mode."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.finished(S.sessions(S.replayed(e, "events"), "user_id", "ts", "30 minutes", "10 minutes"), "sessions", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("value", 4).alias("value"))


@query("""WITH m AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role || ': ' || substr(coalesce(text, ''), 1, 200) AS line FROM conversations)
SELECT a.conv, a.pos, least(a.pos + 1, 1) + least(a.pos, 2) + CASE WHEN a.pos > 2 THEN 1 ELSE 0 END AS n_seen,
  least(1000, length(coalesce((SELECT string_agg(line, chr(10) ORDER BY b.pos) FROM m b WHERE b.conv = a.conv AND b.pos >= 1 AND b.pos <= a.pos - 2), ''))) AS summary_chars FROM m a""")
def stream_rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, rolling summary and the last two messages after each message, with state by conversation."""
    return S.finished(S.rolling_summary(S.replayed(messages(spark, sf_dir), "messages"), 2, 1), "rolling")
