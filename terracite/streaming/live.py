"""Structured Streaming counterparts: completion claims, windows and enrichment (see also ``commits``, ``turns`` and ``board``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claim_completions(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """The first completed event of each source; repeats within the watermark are dropped."""
    done = events.where("status = 'COMPLETED'").withWatermark("ts", watermark)
    return done.dropDuplicatesWithinWatermark(["source_id"]) if events.isStreaming else done.groupBy("source_id").agg(F.min("ts").alias("ts"))


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, gap: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Events by status in tumbling or sliding windows, or by source in sessions with a gap. Later than the watermark is
    dropped."""
    rows = events.withWatermark("ts", watermark)
    if gap is not None:
        out = rows.groupBy(F.session_window("ts", gap).alias("w"), "source_id")
    else:
        out = rows.groupBy(F.window("ts", window, slide).alias("w"), "status")
    key = "source_id" if gap is not None else "status"
    return out.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def enrich_stream(events: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """Events with their source's project and region; the dimensions are static."""
    dims = sources.select(F.col("id").alias("source_id"), "project_id").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"), "region"), "project_id")
    return events.join(dims, "source_id")
