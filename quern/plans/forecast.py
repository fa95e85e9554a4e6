"""Forecasters: tables of a panel and cutoffs in, a table (cutoff, series_id, date, yhat) out.

The cutoff is a column. All cutoffs of a backtest are one plan; nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import LEVEL_DAYS, SHAPE_OBS, STEP_TAU, TREND_CLIP, TREND_DAMP, TREND_K
from quern.functions.calendar import multiplier_group
from quern.operators import events as E
from quern.operators import rolling as R
from quern.session import written_together


@dataclass
class Inputs:
    """What forecasters read: the panel, its series, cutoffs, and the calendar."""

    panel: DataFrame
    series: DataFrame
    cutoffs: DataFrame
    special: DataFrame
    damp: DataFrame | Callable[[], DataFrame]  # a function where few forecasters need it
    horizon: int = 14
    types: DataFrame | Callable[[], DataFrame] | None = None  # (date, day_type), for tree models

    def targets(self) -> DataFrame:
        """(cutoff, date, lead) of all days ahead."""
        lead = F.explode(F.sequence(F.lit(1), F.lit(self.horizon)))
        return self.cutoffs.select("cutoff", lead.alias("lead")).select("cutoff", F.date_add("cutoff", F.col("lead")).alias("date"), "lead")

    def cells(self) -> DataFrame:
        """(cutoff, series_id, date, lead, weekday, name): each series and day ahead, with the day's special name."""
        t = self.targets().join(F.broadcast(self.special), "date", "left")
        return self.series.select("series_id").crossJoin(F.broadcast(t)).withColumn("weekday", F.weekday("date"))

    @property
    def damped(self) -> DataFrame:
        return self.damp() if callable(self.damp) else self.damp

    @property
    def day_types(self) -> DataFrame:
        if self.types is None:
            raise ValueError("tree models need the types of days")
        return self.types() if callable(self.types) else self.types

    @property
    def clean(self) -> DataFrame:
        return R.clean_days(self.panel, self.special)

    @property
    def net(self) -> DataFrame:
        return self.panel.groupBy("date").agg(F.sum("y").alias("net"))


def _out(df: DataFrame, yhat: Column) -> DataFrame:
    return df.select("cutoff", "series_id", "date", yhat.cast("double").alias("yhat"))


def seasonal_naive(x: Inputs) -> DataFrame:
    """The value of a week before, or of two weeks where that is after the cutoff; 0 if there is none."""
    src = F.when(F.col("lead") <= 7, F.date_add("date", -7)).otherwise(F.date_add("date", -14))
    got = x.cells().withColumn("src", src).join(x.panel.select(F.col("date").alias("src"), "series_id", "y"), ["src", "series_id"], "left")
    return _out(got, F.coalesce("y", F.lit(0)))


def weekday_profile(x: Inputs, k: int = 4, days: int = 42) -> DataFrame:
    """Mean of the last k days of the weekday within the last `days`; 0 if there is none."""
    prof = R.last_weekday_mean(x.panel, x.cutoffs, k, days)
    return _out(x.cells().join(prof, ["cutoff", "series_id", "weekday"], "left"), F.coalesce("profile", F.lit(0.0)))


def _special_parts(x: Inputs, cells: DataFrame, factors: DataFrame, bf_default: bool = True) -> DataFrame:
    """`cells` with special_level and factor, the pooled one (1 for bf) where the type has no evidence."""
    level = R.special_level(x.clean, x.cutoffs)
    pooled = E.pooled_factor(factors, x.cutoffs)
    got = cells.join(level, ["cutoff", "series_id"], "left").join(F.broadcast(factors.select("cutoff", "name", "factor")), ["cutoff", "name"], "left")
    got = got.join(F.broadcast(pooled), "cutoff", "left")
    fallback = F.when(F.col("name").startswith("bf"), 1.0).otherwise(F.col("pooled")) if bf_default else F.col("pooled")
    return got.withColumn("factor", F.coalesce("factor", fallback)).withColumn("special_level", F.coalesce("special_level", F.lit(0.0)))


def holiday_profile(x: Inputs, k: int = 4) -> DataFrame:
    """Clean weekday means; special days: the clean level of 28 days times the type's factor."""
    factors = E.special_factors(E.event_evidence(x.net, x.special), x.cutoffs, "none")
    prof = R.last_weekday_mean(x.clean, x.cutoffs, k)
    got = _special_parts(x, x.cells(), factors).join(prof, ["cutoff", "series_id", "weekday"], "left")
    return _out(got, F.when(F.col("name").isNull(), F.coalesce("profile", F.lit(0.0))).otherwise(F.col("special_level") * F.col("factor")))


def shape_level(x: Inputs, k: int = 4) -> DataFrame:
    """Weekday shape times the shape-deflated level of 14 days; special days as in holiday_profile."""
    factors = E.special_factors(E.event_evidence(x.net, x.special), x.cutoffs, "none")
    shape = R.weekday_shape(x.clean, x.cutoffs, k)
    h = R.half_sums(x.clean, x.cutoffs, shape)
    level = h.select("cutoff", "series_id", R.ratio(F.col("num_recent") + F.col("num_prev"), F.col("den_recent") + F.col("den_prev")).alias("level"))
    got = _special_parts(x, x.cells(), factors).join(shape, ["cutoff", "series_id", "weekday"], "left").join(level, ["cutoff", "series_id"], "left")
    normal = F.coalesce("shape", F.lit(0.0)) * F.coalesce("level", F.lit(0.0))
    return _out(got, F.when(F.col("name").isNull(), normal).otherwise(F.col("special_level") * F.col("factor")))


def levels(x: Inputs, shape: DataFrame, by_day: DataFrame | None, step: bool = True) -> DataFrame:
    """(cutoff, series_id, level, l_recent, l_prev, num_recent): with `step`, a break between the weeks takes the last."""
    h = R.half_sums(x.clean, x.cutoffs, shape, by_day)
    h = h.select(
        "cutoff",
        "series_id",
        "num_recent",
        R.ratio(F.col("num_recent") + F.col("num_prev"), F.col("den_recent") + F.col("den_prev")).alias("level"),
        R.ratio(F.col("num_recent"), F.col("den_recent")).alias("l_recent"),
        R.ratio(F.col("num_prev"), F.col("den_prev")).alias("l_prev"),
    )
    if not step:
        return h
    broke = (F.col("l_recent") > 0) & (F.col("l_prev") > 0) & (F.abs(F.ln(F.try_divide("l_recent", F.nullif("l_prev", F.lit(0.0))))) > STEP_TAU)
    return h.withColumn("level", F.when(broke, F.col("l_recent")).otherwise(F.col("level")))


def hand(x: Inputs, k: int = SHAPE_OBS, step: bool = True, mode: str = "drifting", trend: bool = False, vacation: bool = False, split: bool = False, decayed: bool = True) -> DataFrame:
    """Shape, damp-aware level, event factors and series multipliers; the rest are variants, off by default."""
    # Small tables that several parts read; the level's shape is read twice.
    shape, factors, damp = written_together(
        shape=R.weekday_shape(x.clean, x.cutoffs, k),
        factors=E.special_factors(E.event_evidence(x.net, x.special), x.cutoffs, mode),
        damp=E.damp_factors(E.damp_pairs(x.net, x.special, x.damped), x.damped, x.cutoffs, mode),
    )
    by_day = E.damp_by_day(x.damped, damp)
    mult = E.series_multipliers(x.panel, x.special, factors, x.cutoffs, split, decayed)
    level = levels(x, shape, by_day, step and not trend)
    got = _special_parts(x, x.cells(), factors).withColumn("grp", multiplier_group(F.col("name"), split))
    got = got.join(mult, ["cutoff", "series_id", "grp"], "left").join(shape, ["cutoff", "series_id", "weekday"], "left")
    got = got.join(level, ["cutoff", "series_id"], "left").join(F.broadcast(by_day), ["cutoff", "date"], "left")
    normal = F.coalesce("shape", F.lit(0.0)) * F.coalesce("level", F.lit(0.0)) * F.coalesce("damp", F.lit(1.0))
    if trend:
        normal = normal * F.pow(trend_growth(), F.col("lead") / 7.0)
    if vacation:
        v = E.vacation_multipliers(x.panel, x.special, x.damped, damp, x.cutoffs).withColumnRenamed("mult", "vac")
        days = E.day_damp(x.damped).select("date", F.lit(True).alias("is_damp"))
        got = got.join(v, ["cutoff", "series_id"], "left").join(F.broadcast(days), "date", "left")
        normal = normal * F.when(F.col("is_damp"), F.coalesce("vac", F.lit(1.0))).otherwise(1.0)
    special = F.col("special_level") * F.col("factor") * F.coalesce("mult", F.lit(1.0))
    return _out(got, F.when(F.col("name").isNull(), normal).otherwise(special))


def trend_growth() -> Column:
    """Weekly growth, clipped, weighted by recent volume and damped."""
    g = F.when((F.col("l_prev") > 0) & (F.col("l_recent") > 0), F.try_divide("l_recent", F.nullif("l_prev", F.lit(0.0)))).otherwise(1.0)
    weight = F.col("num_recent") / (F.col("num_recent") + TREND_K)
    return F.coalesce(1.0 + TREND_DAMP * weight * (E.clip(g, *TREND_CLIP) - 1.0), F.lit(1.0))


def bf_informed_level(x: Inputs, k: int = 4) -> DataFrame:
    """(cutoff, series_id, level): Black Friday days count too, as y over factor and multiplier, with weight 1."""
    shape = R.weekday_shape(x.clean, x.cutoffs, k)
    factors = E.special_factors(E.event_evidence(x.net, x.special), x.cutoffs, "none")
    mult = E.series_multipliers(x.panel, x.special, factors, x.cutoffs, decayed=False).filter("grp = 'bf'").select("cutoff", "series_id", "mult")
    h = R.half_sums(x.clean, x.cutoffs, shape).select("cutoff", "series_id", (F.col("num_recent") + F.col("num_prev")).alias("num"), (F.col("den_recent") + F.col("den_prev")).alias("den"))
    days = x.special.filter(F.col("name").startswith("bf")).join(factors.select("cutoff", "name", "factor"), "name").filter("factor > 0.05")
    days = days.filter((F.col("date") <= F.col("cutoff")) & (F.col("date") > F.date_add("cutoff", -LEVEL_DAYS)))
    bf = F.broadcast(days).join(x.panel, "date").join(mult, ["cutoff", "series_id"], "left")
    bf = bf.groupBy("cutoff", "series_id").agg(F.sum(F.col("y") / (F.col("factor") * F.coalesce("mult", F.lit(1.0)))).alias("num"), F.sum(F.lit(1.0)).alias("den"))
    both = h.unionByName(bf).groupBy("cutoff", "series_id").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return both.select("cutoff", "series_id", R.ratio(F.col("num"), F.col("den")).alias("level"))


def blend_weights(x: Inputs) -> DataFrame:
    """(cutoff, series_id, w_l1, w_other): the burstier a series, the more weight of the first head, up to 0.70."""
    rho = R.burstiness(x.clean, x.cutoffs)
    s = E.clip((F.lit(0.75) - F.col("rho")) / 0.5, 0.0, 1.0)
    w = F.lit(1 / 3) + s * (0.70 - 1 / 3)
    return rho.select("cutoff", "series_id", "rho", w.alias("w_l1"), ((1.0 - w) / 2).alias("w_other"))


def blend(parts: list[tuple[DataFrame, Column | float]], weights: DataFrame | None = None) -> DataFrame:
    """Weighted sum of forecasts by cutoff, series and day; weights may be columns of `weights`, missing ones are 1/3."""
    keys = ["cutoff", "series_id", "date"]
    got = None
    for k, (df, _) in enumerate(parts):
        one = df.select(*keys, F.col("yhat").alias(f"y{k}"))
        got = one if got is None else got.join(one, keys)
    if weights is not None:
        got = got.join(weights, ["cutoff", "series_id"], "left")
    total = sum((F.col(f"y{k}") * (F.coalesce(w, F.lit(1 / 3)) if isinstance(w, Column) else F.lit(w)) for k, (_, w) in enumerate(parts)), F.lit(0.0))
    return _out(got, total)


def bursty_blend(x: Inputs, hand_part: DataFrame, l1: DataFrame, l2: DataFrame) -> DataFrame:
    return blend([(hand_part, F.col("w_other")), (l1, F.col("w_l1")), (l2, F.col("w_other"))], blend_weights(x))


FORECASTERS: dict[str, Callable[[Inputs], DataFrame]] = {
    "seasonal_naive": seasonal_naive,
    "weekday_profile": weekday_profile,
    "holiday_profile": holiday_profile,
    "shape_level": shape_level,
    "hand": hand,
}
