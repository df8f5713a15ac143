"""The same counters over streams: windowed counts with watermarks, running entity counts, first sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Event time as a timestamp, which watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed(events: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, stop, by..., n) of each window; events later than the watermark are dropped and the window's state with them."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _timed(events, time).withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, stop, n) of runs of events with pauses shorter than gap."""
    out = _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def items(documents: DataFrame, column: str) -> DataFrame:
    """(item, n) running counts of a list column: complete or update mode."""
    return documents.select(F.explode(F.array_distinct(column)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def first_seen(documents: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Documents whose key wasn't seen within the watermark: duplicates of an endless input."""
    return _timed(documents, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is available now, as a table in memory: for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
