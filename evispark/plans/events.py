"""Event queries: windows over time, JSON paths, and the same by stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events as E
from .base import Registry

R = Registry()


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_json_path(t):
    """A value by its path; malformed JSON has none."""
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@R.add(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS total FROM events GROUP BY 1, 2"""
)
def q_stream_windows(t):
    """Hourly counts; the stream of the same gives the same rows."""
    return E.windowed_counts(t.events)


@R.add(
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s"""
)
def q_stream_sessions(t):
    """Sessions of users."""
    return E.sessions(t.events)


@R.add("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def q_event_types(t):
    """Events and users by type."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


QUERIES, ORACLE_SQL = R.queries, R.sql
