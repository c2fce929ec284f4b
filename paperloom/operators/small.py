"""Broadcast behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def few(table: DataFrame, limit: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has ``limit`` rows at most; else Spark joins it as it sees fit."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
