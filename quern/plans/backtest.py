"""Walk-forward scoring: cutoffs as rows, checks of the forecast's contract, actuals, and the activity mask."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import PanelConfig, Stage


def mondays(first: str, last: str) -> list[dt.date]:
    """All Mondays from first to last, which must be Mondays themselves."""
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    if a.weekday() or b.weekday():
        raise ValueError("the first and the last cutoff must be Mondays")
    return [a + dt.timedelta(days=k) for k in range(0, (b - a).days + 1, 7)]


def cutoffs(spark: SparkSession, dates) -> DataFrame:
    days = [d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in dates]
    return spark.createDataFrame([(d,) for d in days], "cutoff date")


def stage_days(config: PanelConfig, name: str, allow_locked: bool = False) -> list[dt.date]:
    """Cutoffs of a stage; refuses an unknown or a locked one, and horizons beyond the end of the panel."""
    if name not in config.stages:
        raise ValueError(f"unknown stage {name}; known: {', '.join(config.stages)}")
    s: Stage = config.stages[name]
    if s.locked and not allow_locked:
        raise PermissionError(f"stage {name} is locked")
    days = mondays(s.first_cutoff, s.last_cutoff)
    if days[-1] + dt.timedelta(days=config.horizon) > dt.date.fromisoformat(config.end):
        raise ValueError("the horizon of the last cutoff ends after the panel")
    return days


def contract(predictions: DataFrame, series: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of counts, all 0 for a valid forecast: nulls, repeats, missing and unexpected cells; and negatives."""
    keys = ["cutoff", "series_id", "date"]
    expected = series.select("series_id").crossJoin(F.broadcast(targets.select("cutoff", "date"))).withColumn("want", F.lit(1))
    got = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("yhat").isNull() | F.isnan("yhat")).alias("bad"), F.count_if(F.col("yhat") < 0).alias("neg"))
    both = expected.join(got, keys, "full_outer")
    return both.agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("n_repeated"),
        F.count_if(F.col("n").isNull()).alias("n_missing"),
        F.count_if(F.col("want").isNull()).alias("n_unexpected"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_negative"),
    )


def check(predictions: DataFrame, series: DataFrame, targets: DataFrame) -> int:
    """Raises for a forecast that breaks the contract; returns how many values were negative."""
    row = contract(predictions, series, targets).first()
    faults = {k: v for k, v in row.asDict().items() if v and k != "n_negative"}
    if faults:
        raise ValueError(f"the forecast breaks the contract: {faults}")
    return row.n_negative


def scored_cells(predictions: DataFrame, panel: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, kind, cutoff, date, lead, y, yhat) of series that had begun by the cutoff; negatives become 0."""
    named = predictions.join(F.broadcast(series), "series_id").filter(F.col("first_date") <= F.col("cutoff"))
    actual = named.join(panel, ["date", "series_id"], "left")
    return actual.select("series_id", "kind", "cutoff", "date", F.datediff("date", "cutoff").alias("lead"), "y", F.greatest("yhat", F.lit(0.0)).alias("yhat"))
