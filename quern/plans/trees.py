"""A global model of the ratio of volume to level: gradient boosting of all cutoffs at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.calendar import edge_distances
from quern.operators.boosting import IN_MEMORY, Boosting, Layout, binned, boost, layout
from quern.operators.features import age_decay, feature_rows, labelled, training_refs
from quern.plans.forecast import FORECASTERS, Inputs, blend, bursty_blend, hand
from quern.session import discard, written

NUMBERS = ("lead", "weekday", "month", "to_special", "since_special", "l14_log", "l28_ratio", "l7_ratio", "lag0_ratio", "lag1_ratio", "lag2_ratio", "lag3_ratio", "age_days", "active_60")
CATEGORIES = ("day_type", "series_id")
#: Rounds, leaves and step of the model in its first and its last form.
FIRST = Boosting(rounds=300, leaves=63, step=0.06)
LAST = Boosting()
#: Bins of a number, one of them for missing values.
BINS = 127


def model_rows(x: Inputs, weekdays: tuple[int, ...] = (0, 3), decayed: bool = False, bins: int = BINS) -> tuple[DataFrame, Layout]:
    """The rows that each cutoff's model learns from and those that it is asked for, as `boost` takes them.

    Features of a reference day depend on the days up to it only (the target on the horizon after it). So they are
    computed, binned and written once for all references, and each cutoff learns from those whose horizon it knows. Bins
    are set by the references that the first cutoff knows, so no cutoff's bins depend on later days. `decayed` halves
    weights by age.
    """
    first, last = (x.cutoffs.agg(f("cutoff").alias("cutoff")) for f in (F.min, F.max))
    refs = training_refs(x.panel, last, weekdays).select("ref").union(x.cutoffs.select("cutoff")).distinct()
    span = x.panel.select("date").distinct()
    edges = edge_distances(span.union(span.select(F.date_add("date", 60))).distinct(), x.special)
    rows = written(feature_rows(x.panel, x.special, x.day_types, edges, refs, x.horizon), "features")
    early = labelled(rows.join(F.broadcast(training_refs(x.panel, first, weekdays).select("ref")), "ref", "left_semi"))
    of = layout(rows, NUMBERS, CATEGORIES, bins, early)
    table = written(binned(rows.withColumn("key", F.xxhash64("ref", "series_id", "lead")), of, ("ref", "series_id", "date", "key", "base", "actual")), "binned")
    discard(rows)
    known = training_refs(x.panel, x.cutoffs, weekdays).select(F.col("cutoff").alias("model"), "ref")
    train = labelled(table).join(F.broadcast(known), "ref")
    if decayed:
        train = train.withColumn("weight", F.col("weight") * age_decay(F.col("model")))
    ahead = table.join(F.broadcast(x.cutoffs.select(F.col("cutoff").alias("model"))), F.col("ref") == F.col("model"))
    ahead = ahead.withColumns({"label": F.lit(None).cast("double"), "weight": F.lit(0.0)})
    return train.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True))), of


def gradient_boosted(x: Inputs, p: Boosting = LAST, rows: tuple[DataFrame, Layout] | None = None, in_memory: int = IN_MEMORY) -> DataFrame:
    """A model for each cutoff, as each may only see what was known then; all of them in one plan. `rows` are those of
    model_rows, if they are at hand. Days without a level over 1 are forecast as 0."""
    got = boost(*(rows or model_rows(x)), p, ("series_id", "date", "base"), in_memory)
    base = F.coalesce("base", F.lit(0.0))
    return got.select(F.col("model").alias("cutoff"), "series_id", "date", F.when(base > 1.0, F.greatest("value", F.lit(0.0)) * base).otherwise(0.0).alias("yhat"))


def heads(x: Inputs, p: Boosting = LAST) -> tuple[DataFrame, DataFrame]:
    """The forecasts of absolute and of squared loss, from the same rows."""
    rows = model_rows(x)
    return tuple(gradient_boosted(x, replace(p, loss=loss), rows) for loss in ("absolute", "squared"))


def thirds(x: Inputs, p: Boosting = LAST) -> DataFrame:
    """The plain mean of the hand-made head and the two tree heads."""
    return blend([(part, 1 / 3) for part in (hand(x), *heads(x, p))])


def full_blend(x: Inputs, p: Boosting = LAST) -> DataFrame:
    """The three heads, weighted by each series' burstiness."""
    return bursty_blend(x, hand(x), *heads(x, p))


#: All registered forecasters.
ALL: dict[str, Callable[[Inputs], DataFrame]] = FORECASTERS | {
    "gbt": gradient_boosted,
    "gbt_first": partial(gradient_boosted, p=FIRST),
    "gbt_squared": partial(gradient_boosted, p=replace(LAST, loss="squared")),
    "thirds": thirds,
    "full_blend": full_blend,
}
