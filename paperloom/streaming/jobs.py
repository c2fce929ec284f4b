"""State of parsing jobs from their events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ("completed", "error")


def latest(events: DataFrame) -> DataFrame:
    """The newest event of each file; of events at one time that of the highest seq (if there is such a column)."""
    rest = [c for c in events.columns if c != "file_id"]
    order = F.struct("ts", *(["seq"] if "seq" in events.columns else []))
    return events.groupBy("file_id").agg(F.max_by(F.struct(*rest), order).alias("e")).select("file_id", "e.*")


def completed(events: DataFrame) -> DataFrame:
    return latest(events).where("status = 'completed'")


def progress_of(events: DataFrame, file_id: str) -> DataFrame:
    """The state of one file; no row where it is unknown."""
    return latest(events.where(F.col("file_id") == file_id))


def progress_of_status(progress="progress", status="status"):
    """Progress as shown: 100 when completed, 0 after an error."""
    return F.when(F.col(status) == "completed", 100).when(F.col(status) == "error", 0).otherwise(F.col(progress))


def stream_latest(events: DataFrame) -> DataFrame:
    """``latest`` over a stream: a small state per file, for output mode update or complete."""
    return latest(events)


def stream_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per status in windows of event time; windows close once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "status", "events")
