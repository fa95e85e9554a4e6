"""Daily counts of an event stream: an extension, as the engine's own inputs are batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _counted(events: DataFrame) -> DataFrame:
    counted = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast("date").alias("date"), "event_type", "n", "total")


def daily_event_counts(events: DataFrame) -> DataFrame:
    """(date, event_type, n, total) by event time, of all events so far: for complete or update mode. No day closes, and
    the state holds a row for each day and type."""
    return _counted(events.withColumn("ts", F.col("ts").cast("timestamp")))


def closed_daily_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """(date, event_type, n, total) of days that have closed: for append mode.

    A day closes when an event `lateness` after its end has been seen; it is given out once and leaves the state. Events
    that are sent again within that time count once. Events later than that are dropped one by one, before any are
    counted together, and late_events tells how many there were.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return _counted(stamped.dropDuplicatesWithinWatermark(["event_id"]))


def late_events(query: StreamingQuery) -> int:
    """Events that a query of closed_daily_counts has dropped, as far as its progress is kept."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators if o.operatorName == "dedupeWithinWatermark")


def open_state(query: StreamingQuery) -> int:
    """Rows that a query's state holds after its last batch."""
    return sum(o.numRowsTotal for o in query.lastProgress.stateOperators) if query.lastProgress else 0
