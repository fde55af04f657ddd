"""Gap, debounce and throttle operators over streams of map events (user, ts, zoom, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, gap: str = "250 milliseconds", levels: int = 2, late: str = "10 seconds") -> DataFrame:
    """Sessions of events less than ``gap`` apart with first and last time, count, and whether the zoom spanned ``levels``."""
    w = F.session_window("ts", gap)
    s = events.withWatermark("ts", late).groupBy("user", w.alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), (F.max("zoom") - F.min("zoom") >= levels).alias("burst"))
    return s.select("user", "first", "last", "n", "burst")


def debounce(events: DataFrame, wait: str = "150 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last event of each run of events less than ``wait`` apart."""
    s = events.withWatermark("ts", late).groupBy("user", F.session_window("ts", wait)).agg(F.max(F.struct("ts", "x", "y", "zoom")).alias("e"))
    return s.select("user", "e.*", F.col("session_window.end").alias("fires"))


def throttle(events: DataFrame, every: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The first event of each user and interval."""
    s = events.withWatermark("ts", late).groupBy("user", F.window("ts", every)).agg(F.min(F.struct("ts", "x", "y", "zoom")).alias("e"))
    return s.select("user", "e.*")


def distinct_requests(requests: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Each (url) once within the watermark: joins of requests in flight."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])
