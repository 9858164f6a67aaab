"""Streams over events, run to the end of the available input and read back from their sink."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuseval.catalog.views import table
from corpuseval.session import scratch_dir
from corpuseval.streaming import progress

PARTS, SESSION_GAP = 4, "6 hours"


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return progress.corpus_stream(spark, sf, schema, glob="events.parquet").select(
        F.to_date("ts").cast("string").alias("run_id"),
        F.col("user_id").alias("item_id"),
        F.col("event_type").alias("status"),
        F.col("value").alias("latency_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def stream_progress(spark, sf):
    root = scratch_dir(spark)
    progress.run_available(progress.write_counts(_arrivals(spark, sf), f"{root}/counts", f"{root}/checkpoint"))
    return progress.read_counts(spark, f"{root}/counts")


def stream_append(spark, sf):
    """Appended once per event; the source is read twice to make every event a duplicate."""
    root = scratch_dir(spark)
    rows = _arrivals(spark, sf)
    doubled = rows.unionByName(_arrivals(spark, sf))
    progress.run_available(
        progress.append_stream(
            doubled, f"{root}/results", f"{root}/checkpoint", ["run_id", "event_id"], lateness="40 days"
        )
    )
    stored = spark.read.parquet(f"{root}/results")
    return stored.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def stream_pending(spark, sf):
    """Arriving users that have no stored purchase."""
    root = scratch_dir(spark)
    table(spark, sf, "events").filter("event_type = 'purchase' and value > 100").select(
        F.col("user_id").alias("item_id")
    ).write.parquet(f"{root}/results")
    arriving = _arrivals(spark, sf).select("item_id", "event_id", "status")
    progress.run_available(
        progress.pending_stream(arriving, f"{root}/results", f"{root}/pending", f"{root}/checkpoint")
    )
    return spark.read.parquet(f"{root}/pending").select("item_id", "event_id", "status")


def _windowed(spark, sf, **frame) -> DataFrame:
    """Changed windows per micro-batch, newest per window; closed windows leave the state."""
    root = scratch_dir(spark)
    rows = _arrivals(spark, sf).select("status", "latency_ms", "ts")
    windows = progress.windowed_status(rows, lateness="1 day", **frame)
    keys = ["window_start", "window_end", "status"]
    progress.run_available(progress.write_progress(windows, f"{root}/windows", f"{root}/checkpoint"))
    return progress.read_progress(spark, f"{root}/windows", keys)


def _readable(df: DataFrame) -> DataFrame:
    shape = "yyyy-MM-dd HH:mm:ss"
    return df.select(
        F.date_format("window_start", shape).alias("window_start"), F.date_format("window_end", shape).alias("window_end"),
        "status", "n", "mean_latency_ms", "max_latency_ms",
    )


def stream_windows(spark, sf):
    return _readable(_windowed(spark, sf, size="1 day"))


def stream_sliding(spark, sf):
    return _readable(_windowed(spark, sf, size="2 days", slide="1 day"))


def stream_sessions(spark, sf):
    """Sessions of a user and status as a stream of several files, one per micro-batch, in the order of their days.

    A last file holds one event of a user of its own, 30 days later: its watermark closes all other sessions.
    """
    root = scratch_dir(spark)
    events = table(spark, sf, "events").select(
        F.col("user_id"), F.col("event_type").alias("status"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("ts")
    )
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    edges = [first + (last - first) * k / PARTS for k in range(PARTS)] + [last + timedelta(seconds=1)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = events.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(f"{root}/events")
    closing = events.filter(F.col("ts") == F.lit(last)).limit(1)
    closing = closing.select(F.lit(-1).cast("long").alias("user_id"), "status", "latency_ms", (F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    closing.coalesce(1).write.mode("append").parquet(f"{root}/events")
    arriving = progress.corpus_stream(spark, f"{root}/events", events.schema, files_per_trigger=1)
    sessions = progress.windowed_status(arriving, session_gap=SESSION_GAP, lateness="1 hour", keys=("user_id", "status"))
    progress.run_available(progress.append_sessions(sessions, f"{root}/sessions", f"{root}/checkpoint"))
    shape = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return spark.read.parquet(f"{root}/sessions").filter("user_id >= 0").select(
        "user_id", "status", F.date_format("window_start", shape).alias("window_start"),
        F.date_format("window_end", shape).alias("window_end"), "n", "mean_latency_ms", "max_latency_ms",
    )


def session_status(spark, sf):
    """Session windows of the same definition over the bounded table."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("status"), F.col("value").alias("latency_ms"), "ts"
    )
    sessions = progress.windowed_status(rows, session_gap="10 minutes")
    return sessions.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"), "status", "n", "mean_latency_ms", "max_latency_ms"
    )


QUERIES = {
    f.__name__: f
    for f in (stream_progress, stream_append, stream_pending, stream_windows, stream_sliding, stream_sessions, session_status)
}

_COUNTS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS status, count(*) AS n FROM events GROUP BY ALL"

ORACLES = {
    "stream_progress": _COUNTS,
    "stream_append": _COUNTS,
    "stream_pending": """SELECT user_id AS item_id, event_id, event_type AS status FROM events
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)""",
    "stream_windows": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type AS status, count(*) AS n,
       round(avg(value), 6) AS mean_latency_ms, max(value) AS max_latency_ms FROM events GROUP BY ALL""",
    "stream_sliding": """WITH w AS (
  SELECT *, date_trunc('day', ts) AS s FROM events UNION ALL SELECT *, date_trunc('day', ts) - INTERVAL 1 DAY AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type AS status,
       count(*) AS n, round(avg(value), 6) AS mean_latency_ms, max(value) AS max_latency_ms FROM w GROUP BY ALL""",
    "stream_sessions": """WITH o AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, event_type AS status, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
       strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, count(*) AS n,
       round(avg(value), 6) AS mean_latency_ms, max(value) AS max_latency_ms FROM g GROUP BY user_id, event_type, session""",
    "session_status": """WITH o AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type AS status, count(*) AS n,
       round(avg(value), 6) AS mean_latency_ms, max(value) AS max_latency_ms FROM g GROUP BY event_type, session""",
}
