"""A frozen panel that is brought up to date: only the months are written again that hold a day that has changed.

The panel and the levels are folders with a partition for each month. Beside the panel are the digests of its days. Late
cancellations change past days; a refresh compares digests and overwrites the months of the days that differ, then the
levels whose windows reach back to them. Data are written before their digests, so a refresh that was cut off is done
again by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.rolling import WINDOW, masked, rolling_levels
from quern.session import written

LEVELS = ("date", "series_id", "l7", "l14_raw", "l28", "l56", "l14", "active_60")


def month_of(day: Column | str) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_digests(panel: DataFrame) -> DataFrame:
    """(date, digest): SHA-256 over a day's series and counts in order."""
    cells = F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "series_id", F.col("y").cast("string")))), ";")
    return panel.groupBy("date").agg(F.sha2(cells, 256).alias("digest"))


def _write(df: DataFrame, path: str, *order: str) -> None:
    """Overwrites the months that `df` has, and no others."""
    out = df.withColumn("month", month_of("date")).repartition("month").sortWithinPartitions("month", *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(path)


def read_months(spark, path: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A folder by months, of the days from `first` to `last`, if given; other months are not read."""
    df = spark.read.option("basePath", path).parquet(path)
    for bound, later in ((first, True), (last, False)):
        if bound is not None:
            month, day = F.col("month").cast("string"), F.col("date")
            df = df.filter((month >= month_of(bound)) & (day >= bound) if later else (month <= month_of(bound)) & (day <= bound))
    return df.drop("month")


def freeze(panel: DataFrame, path: str, special: DataFrame) -> None:
    """Writes the panel, the digests of its days and its levels for the first time."""
    _write(panel.select("date", "series_id", "y"), f"{path}/panel", "date", "series_id")
    kept = read_months(panel.sparkSession, f"{path}/panel")
    _write(rolling_levels(masked(kept, special)).select(*LEVELS), f"{path}/levels", "series_id", "date")
    _write(day_digests(kept), f"{path}/digests", "date")


def refresh(panel: DataFrame, path: str, special: DataFrame) -> DataFrame:
    """Brings a frozen panel up to `panel`; gives the (date) that have changed. Days that are no longer there are refused.

    Levels look back WINDOW days at most. So those of a day may change if a day does that lies less than that before it;
    they are computed from the days from WINDOW days before the first of them on.
    """
    spark = panel.sparkSession
    panel = written(panel.select("date", "series_id", "y"), "panel")
    now, before = day_digests(panel), read_months(spark, f"{path}/digests").withColumnRenamed("digest", "before")
    changed = written(now.join(before, "date", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("before"))).select("date", F.col("digest").isNull().alias("lost")), "changed")
    bounds = changed.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_if("lost").alias("lost")).first()
    if bounds.lost:
        raise ValueError(f"{bounds.lost} days of the frozen panel are missing")
    if bounds.first is None:
        return changed.select("date")
    months = changed.select(month_of("date").alias("month")).distinct()
    _write(panel.join(F.broadcast(months), month_of("date") == F.col("month"), "left_semi"), f"{path}/panel", "date", "series_id")

    reached = changed.select(F.explode(F.sequence("date", F.date_add("date", WINDOW - 1))).alias("date")).select(month_of("date").alias("month")).distinct()
    first = F.trunc(F.lit(bounds.first), "MM")
    some = read_months(spark, f"{path}/panel", F.date_add(first, 1 - WINDOW), F.last_day(F.date_add(F.lit(bounds.last), WINDOW - 1)))
    levels = rolling_levels(masked(some, special)).select(*LEVELS)
    _write(written(levels.join(F.broadcast(reached), month_of("date") == F.col("month"), "left_semi"), "levels"), f"{path}/levels", "series_id", "date")
    _write(written(now.join(F.broadcast(months), month_of("date") == F.col("month"), "left_semi"), "digests"), f"{path}/digests", "date")
    return changed.select("date")
