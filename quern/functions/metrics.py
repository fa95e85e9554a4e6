"""Accuracy of scored cells (cutoff, date, series_id, kind, lead, y, yhat): one pass of conditional sums each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def error() -> Column:
    return F.col("yhat") - F.col("y")


def wmape(where: Column | None = None) -> Column:
    """Sum of absolute errors over the sum of y; null unless that is positive."""
    pick = (lambda x: F.sum(F.when(where, x))) if where is not None else F.sum
    return F.when(pick(F.col("y")) > 0, pick(F.abs(error())) / pick(F.col("y")))


def bias() -> Column:
    return F.when(F.sum("y") > 0, F.sum(error()) / F.sum("y"))


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """wmape, mae, rmse, bias and counts, overall or by `by`."""
    grouped = scored.groupBy(*(by or []))
    return grouped.agg(
        wmape().alias("wmape"),
        F.avg(F.abs(error())).alias("mae"),
        F.sqrt(F.avg(error() * error())).alias("rmse"),
        bias().alias("bias"),
        F.count("*").alias("n_cells"),
        F.countDistinct("series_id").alias("n_series"),
        F.countDistinct("cutoff").alias("n_cutoffs"),
    )


def slices(scored: DataFrame) -> DataFrame:
    """wmape of leads 1-7 and 8-14, customers and tail groups, in one row."""
    kind, lead = F.col("kind"), F.col("lead")
    return scored.agg(
        wmape().alias("wmape"),
        wmape(lead <= 7).alias("wmape_lead_1_7"),
        wmape(lead >= 8).alias("wmape_lead_8_14"),
        wmape(kind == "customer").alias("wmape_customers"),
        wmape(kind == "tail_group").alias("wmape_tail"),
    )


def network_wmape(scored: DataFrame) -> DataFrame:
    """wmape of the sums of all series by cutoff and day."""
    return scored.groupBy("cutoff", "date").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat")).agg(wmape().alias("network_wmape"))


def per_cutoff(scored: DataFrame) -> DataFrame:
    return scored.groupBy("cutoff").agg(wmape().alias("wmape"), bias().alias("bias"), F.countDistinct("series_id").alias("n_series"))


def worst_series(scored: DataFrame, n: int = 20) -> DataFrame:
    """The n series of most absolute error among those with volume; ties go to the lesser name."""
    s = scored.groupBy("series_id").agg(wmape().alias("wmape"), F.sum("y").alias("volume"), bias().alias("bias"), F.sum(F.abs(error())).alias("abs_error"))
    return s.filter("volume > 0").orderBy(F.desc(F.round("abs_error", 6)), "series_id").limit(n).select("series_id", "wmape", "volume", "bias")
