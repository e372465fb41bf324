"""Queries: streams run to the end of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.streaming import events as E


def _utc(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type, each window once when the watermark has passed it."""
    stream = E.with_end(E.read_events(spark, sf), "ts", sf)
    return _utc(E.run_once(E.tumbling(stream, "ts", "1 hour", "10 minutes", "event_type")).where("event_type IS NOT NULL"), "window_start")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user, closed by thirty minutes without an event."""
    stream = E.with_end(E.read_events(spark, sf), "ts", sf)
    return _utc(E.run_once(E.sessions(stream, "ts", "30 minutes", "10 minutes", "user_id")).where("user_id IS NOT NULL"), "session_start")


def stream_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback counters of each user, kept up to date."""
    return E.run_once(E.feedback(E.read_events(spark, sf), "user_id"), "complete")


def stream_json_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Click events appended to JSON lines, each once by its id under a watermark."""
    stream = E.read_events(spark, sf).withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", "1 hour")
    clicks = stream.where("event_type = 'click'").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "value")
    return E.run_once(clicks, kind="json")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sessions, stream_feedback, stream_json_sink)}
SQL = {
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH a AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      b AS (SELECT *, sum(CASE WHEN gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
      SELECT min(ts) AS session_start, user_id, count(*) AS n FROM b GROUP BY user_id, s""",
    "stream_feedback": """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks,
      round(sum(CASE WHEN event_type = 'click' THEN 1.0::DOUBLE / greatest(1.0::DOUBLE / (1 + (props::JSON->>'k')::DOUBLE % 20), 0.05::DOUBLE) ELSE 0 END), 4) AS ips_clicks, count(*) FILTER (WHERE event_type = 'view') AS views FROM events GROUP BY 1""",
    "stream_json_sink": "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'",
}
