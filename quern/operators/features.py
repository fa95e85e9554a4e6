"""Features of a global tree model: a row for each reference day, lead and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import HALF_LIFE_DAYS, LAG_CAP, TARGET_CAP
from quern.operators.rolling import first_active, masked, rolling_levels


def capped(num, den):
    """num / den within [0, cap]; null where either is missing or den is 0."""
    return F.least(F.greatest(F.try_divide(num, F.nullif(den, F.lit(0.0))), F.lit(0.0)), F.lit(LAG_CAP))


def training_refs(panel: DataFrame, cutoffs: DataFrame, weekdays: tuple[int, ...] = (0, 3), burn_in: int = 120, horizon: int = 14) -> DataFrame:
    """(cutoff, ref): Mondays and Thursdays whose whole horizon is known at the cutoff, after the burn-in."""
    days = panel.select("date").distinct()
    start = days.agg(F.min("date").alias("start"))
    known = days.crossJoin(F.broadcast(start)).filter(F.weekday("date").isin(*weekdays) & (F.col("date") >= F.date_add("start", burn_in)))
    return known.join(F.broadcast(cutoffs.select("cutoff")), F.col("date") <= F.date_add("cutoff", -horizon)).select("cutoff", F.col("date").alias("ref"))


def feature_rows(panel: DataFrame, special: DataFrame, day_type: DataFrame, edges: DataFrame, refs: DataFrame, horizon: int = 14) -> DataFrame:
    """Features at each (ref, series_id, lead), with base (the cascaded level at ref) and y at the target day, if known.

    Levels are windows over the panel read at ref; the four weekly lags start a week before the target, two from lead 8.
    They come from one join: each lag day is a row that is then put into its column.
    """
    level = rolling_levels(masked(panel, special)).withColumnRenamed("date", "ref")
    lead = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    rows = refs.select("ref").distinct().join(level, "ref").select("*", lead.alias("lead")).withColumn("date", F.date_add("ref", F.col("lead")))
    k0 = F.when(F.col("lead") <= 7, 1).otherwise(2)
    lag = rows.select("ref", "series_id", "lead", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"), "date", k0.alias("k0"))
    lag = lag.withColumn("date", F.expr("date_add(date, -7 * (k0 + j))")).join(panel, ["date", "series_id"], "left")
    lags = lag.groupBy("ref", "series_id", "lead").agg(*(F.max(F.when(F.col("j") == j, F.col("y"))).alias(f"lag{j}") for j in range(4)))
    got = rows.join(lags, ["ref", "series_id", "lead"]).join(panel.withColumnRenamed("y", "actual"), ["date", "series_id"], "left")
    got = got.join(F.broadcast(day_type), "date", "left").join(F.broadcast(edges), "date", "left")
    got = got.join(F.broadcast(first_active(panel)), "series_id", "left")
    age = F.when(F.col("first_active").isNull() | (F.col("first_active") > F.col("ref")), -1).otherwise(F.least(F.datediff("ref", "first_active"), F.lit(730)))
    return got.select(
        "ref",
        "series_id",
        "date",
        "lead",
        F.weekday("date").alias("weekday"),
        F.month("date").alias("month"),
        F.coalesce("day_type", F.lit("normal")).alias("day_type"),
        "to_special",
        "since_special",
        F.log1p("l14").alias("l14_log"),
        capped("l28", "l14").alias("l28_ratio"),
        capped("l7", "l14").alias("l7_ratio"),
        *(capped(F.col(f"lag{j}").cast("double"), "l14").alias(f"lag{j}_ratio") for j in range(4)),
        age.alias("age_days"),
        F.col("active_60").alias("active_60"),
        F.col("l14").alias("base"),
        "actual",
    )


def age_decay(cutoff: Column) -> Column:
    """Half for each year between the reference and the cutoff."""
    return F.pow(F.lit(0.5), F.datediff(cutoff, "ref") / HALF_LIFE_DAYS)


def labelled(rows: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Training rows: base over 1 and a known target; label is the capped ratio, weight the base.

    With `cutoff`, weights halve for each year between the reference and it.
    """
    ok = rows.filter("base > 1.0 AND actual IS NOT NULL")
    weight = F.col("base") if cutoff is None else F.col("base") * age_decay(cutoff)
    return ok.withColumns({"label": F.least(F.greatest(F.col("actual") / F.col("base"), F.lit(0.0)), F.lit(TARGET_CAP)), "weight": weight})
