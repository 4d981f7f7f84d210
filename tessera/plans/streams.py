"""Queries that run as streams over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming.incremental import read_stream, run_to_end, windowed_counts


def streamed_event_windows(spark, d):
    """Daily windows of events, run as a stream to its end."""
    rows = run_to_end(spark, windowed_counts(read_stream(spark, d, "events")), ["start", "event_type"])
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", "cents")


QUERIES = {"streamed_event_windows": streamed_event_windows}
ORACLES = {
    "streamed_event_windows": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"""
}
