"""Rolling and recent levels of a dense panel.

A level at a day depends on the days up to it only, so it is computed once for the whole panel and read at each
cutoff. The panel is dense, so rows are days; masked days stay as rows without a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import EVENT_DAYS, LEVEL_DAYS, SHAPE_OBS


def clean_days(p: DataFrame, special: DataFrame) -> DataFrame:
    """Panel rows of days that are not special; the calendar is broadcast."""
    return p.join(F.broadcast(special.select("date")), "date", "left_anti")


def masked(p: DataFrame, special: DataFrame) -> DataFrame:
    """The panel with y_clean: null on special days."""
    flag = special.select("date", F.lit(True).alias("is_special")).distinct()
    return p.join(F.broadcast(flag), "date", "left").withColumn("y_clean", F.when(F.col("is_special").isNull(), F.col("y"))).drop("is_special")


def rolling_mean(value: Column, days: int, least: int) -> Column:
    """Mean over the last `days` rows with this one, null with fewer than `least` values."""
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(1 - days, 0)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


#: Days that the longest window of rolling_levels has.
WINDOW = 60


def rolling_levels(m: DataFrame) -> DataFrame:
    """(date, series_id, l7, l14_raw, l28, l56, l14, active_60) of a masked panel. l14 falls back to l28, then l56."""
    v = F.col("y_clean")
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(1 - WINDOW, 0)
    out = m.select(
        "date",
        "series_id",
        rolling_mean(v, 7, 3).alias("l7"),
        rolling_mean(v, 14, 5).alias("l14_raw"),
        rolling_mean(v, 28, 7).alias("l28"),
        rolling_mean(v, 56, 7).alias("l56"),
        F.avg((F.col("y") > 0).cast("double")).over(w).alias("active_60"),
    )
    return out.withColumn("l14", F.coalesce("l14_raw", "l28", "l56"))


def recent(p: DataFrame, cutoffs: DataFrame, days: int) -> DataFrame:
    """Panel rows of the last `days` days up to each cutoff. The days are listed, so that this is an equi-join."""
    listed = cutoffs.select("cutoff", F.explode(F.sequence(F.date_add("cutoff", 1 - days), F.col("cutoff"))).alias("date"))
    return p.join(F.broadcast(listed), "date")


def as_of(rows: DataFrame, keys: tuple[str, ...], cutoffs: DataFrame) -> DataFrame:
    """`rows` with a cutoff: for each of `keys` and each cutoff the latest row, by date, up to it.

    A row holds until the next one of its keys. The days between the first and the last cutoff that it holds for are
    listed, and cutoffs read it by an equi-join, so rows are not joined with all later cutoffs.
    """
    low, high = (cutoffs.agg(f("cutoff")).scalar() for f in (F.min, F.max))
    known = rows.withColumns({"until": F.date_add(F.lead("date").over(Window.partitionBy(*keys).orderBy("date")), -1), "low": low, "high": high})
    known = known.filter((F.col("date") <= F.col("high")) & (F.col("until").isNull() | (F.col("until") >= F.greatest("low", "date"))))
    holds = F.sequence(F.greatest("date", "low"), F.least(F.coalesce("until", "high"), "high"))
    return known.withColumn("cutoff", F.explode(holds)).drop("until", "low", "high").join(F.broadcast(cutoffs.select("cutoff").distinct()), "cutoff")


def last_weekday_mean(p: DataFrame, cutoffs: DataFrame, k: int = SHAPE_OBS, days: int | None = None) -> DataFrame:
    """(cutoff, series_id, weekday, profile): mean of the last k rows of each weekday, of the last `days` days if set.

    The last k rows are a window over the panel, computed once for each day and read as of each cutoff.
    """
    at = Window.partitionBy("series_id", F.weekday("date")).orderBy("date")
    known = p.select("series_id", "date", F.weekday("date").alias("weekday"), F.collect_list(F.struct("date", "y")).over(at.rowsBetween(1 - k, 0)).alias("last"))
    read = as_of(known, ("series_id", "weekday"), cutoffs)
    last = F.filter("last", lambda x: x["date"] > F.date_add("cutoff", -days)) if days else F.col("last")
    read = read.select("cutoff", "series_id", "weekday", last.alias("last")).filter(F.size("last") > 0)
    total = F.aggregate("last", F.lit(0).cast("long"), lambda a, x: a + x["y"])
    return read.select("cutoff", "series_id", "weekday", (total / F.size("last")).alias("profile"))


def weekday_shape(clean: DataFrame, cutoffs: DataFrame, k: int = SHAPE_OBS) -> DataFrame:
    """(cutoff, series_id, weekday, shape): clean weekday means over the mean of the seven; 0 where that is 0."""
    prof = last_weekday_mean(clean, cutoffs, k)
    total = prof.groupBy("cutoff", "series_id").agg((F.sum("profile") / 7).alias("mean"))
    return prof.join(total, ["cutoff", "series_id"]).select("cutoff", "series_id", "weekday", F.coalesce(F.try_divide("profile", "mean"), F.lit(0.0)).alias("shape"))


def special_level(clean: DataFrame, cutoffs: DataFrame, days: int = EVENT_DAYS) -> DataFrame:
    """(cutoff, series_id, special_level): clean mean from `days` days before the cutoff to it, both included."""
    return recent(clean, cutoffs, days + 1).groupBy("cutoff", "series_id").agg(F.avg("y").alias("special_level"))


def half_sums(clean: DataFrame, cutoffs: DataFrame, shape: DataFrame, day_factor: DataFrame | None = None, days: int = LEVEL_DAYS) -> DataFrame:
    """(cutoff, series_id, num_recent, den_recent, num_prev, den_prev) over the last `days` days, split 7 before the cutoff.

    Numerators are y over the day's damp factor (cutoff, date, damp), denominators the weekday's shape.
    """
    w = recent(clean, cutoffs, days).withColumn("weekday", F.weekday("date"))
    w = w.join(shape, ["cutoff", "series_id", "weekday"], "left")
    w = w.join(day_factor, ["cutoff", "date"], "left") if day_factor is not None else w.withColumn("damp", F.lit(1.0))
    value, weight = F.col("y") / F.coalesce("damp", F.lit(1.0)), F.coalesce("shape", F.lit(0.0))
    later = F.col("date") > F.date_add("cutoff", -7)
    sums = [F.sum(F.when(c, x).otherwise(0.0)).alias(n) for n, c, x in (("num_recent", later, value), ("den_recent", later, weight), ("num_prev", ~later, value), ("den_prev", ~later, weight))]
    return w.groupBy("cutoff", "series_id").agg(*sums)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is not positive."""
    return F.when(den > 0, num / den).otherwise(0.0)


def burstiness(clean: DataFrame, cutoffs: DataFrame, days: int = 84) -> DataFrame:
    """(cutoff, series_id, rho): exact median over mean of clean days, 1 where the mean is not positive."""
    m = recent(clean, cutoffs, days).groupBy("cutoff", "series_id").agg(F.median("y").alias("median"), F.avg("y").alias("mean"))
    return m.select("cutoff", "series_id", F.when(F.col("mean") > 0, F.col("median") / F.col("mean")).otherwise(1.0).alias("rho"))


def first_active(p: DataFrame) -> DataFrame:
    """(series_id, first_active): the first day with volume, null if none."""
    return p.groupBy("series_id").agg(F.min(F.when(F.col("y") > 0, F.col("date"))).alias("first_active"))
