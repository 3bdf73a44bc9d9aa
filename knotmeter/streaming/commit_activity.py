"""Commits by date or author over a stream, in windows that close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_activity(stream: DataFrame, by: str = "date", late: str = "7 days") -> DataFrame:
    """Commits of each project by day, and by author too, over a streaming ``commits`` DataFrame.

    A day is given out once the watermark, ``late`` behind the newest commit, has passed it; its state is
    then dropped, so what is kept depends on the commits of ``late``, not on the history.
    """
    if by not in ("date", "author"):
        raise ValueError("by must be 'date' or 'author'")
    day = F.window("committed_at", "1 day")
    keys = ["project_id"] + (["author"] if by == "author" else [])
    counted = stream.withWatermark("committed_at", late).groupBy(*keys, day).agg(F.count("*").alias("commits"))
    return counted.select(*keys, F.to_date("window.start").alias("date"), "commits")
