"""Daily buckets of a stream: the batch query and the streaming one share their plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(events: DataFrame, time: str = "t", value: str = "value", width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, end, n, value): means in tumbling windows; late is how long a stream waits for late rows."""
    rows = events.withWatermark(time, late) if late else events
    grouped = rows.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg(value).alias(value))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", value)
