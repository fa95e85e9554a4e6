"""What special days and damped weeks do to volumes, estimated from past ones at each cutoff.

A base window is the same for every cutoff, so its rows are expanded to days and joined by equality once; the cutoff
then only decides which evidence counts, and how much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import (
    BF_FACTOR_CLIP,
    EVENT_DAYS,
    EVENT_MIN_OBS,
    FACTOR_CLIP,
    HALF_LIFE_DAYS,
    POOLED_DEFAULT,
    SERIES_CLIP,
    SERIES_K,
    VACATION_CLIP,
)
from quern.functions.calendar import drifting, multiplier_group
from quern.operators.rolling import as_of


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def decay(cutoff: Column | str, day: Column | str) -> Column:
    """Half for each year between the day and the cutoff."""
    return F.pow(F.lit(0.5), F.datediff(cutoff, day) / HALF_LIFE_DAYS)


def decaying(name: Column, mode: str = "drifting") -> Column:
    """Whether evidence of a type loses weight with age: of `none`, of `all`, or of `drifting` types."""
    return F.lit(mode == "all") if mode in ("none", "all") else drifting(name)


#: Decayed sums are kept as of this day, so that one running sum serves all cutoffs.
EPOCH = "2000-01-01"


def decayed_sums(evidence: DataFrame, keys: tuple[str, ...], decays: Column, values: tuple[str, ...], cutoffs: DataFrame) -> DataFrame:
    """(cutoff, keys, values): sums of the evidence (keys, date, values) up to each cutoff, halved for each year of age
    where `decays`.

    A running sum of values that are scaled to one day is read as of each cutoff and scaled to it.
    """
    epoch = F.lit(EPOCH).cast("date")
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    scaled = evidence.withColumn("decays", decays)
    running = scaled.select(*keys, "date", "decays", *(F.sum(F.col(v) * F.when(F.col("decays"), decay(epoch, "date")).otherwise(1.0)).over(upto).alias(v) for v in values))
    return as_of(running, keys, cutoffs).select("cutoff", *keys, *((F.col(v) * F.when(F.col("decays"), decay("cutoff", epoch)).otherwise(1.0)).alias(v) for v in values))


def base_windows(days: DataFrame, low: int = -EVENT_DAYS, high: int = 0) -> DataFrame:
    """`days` (date, ...) with a row for each base_date in [date + low, date + high)."""
    return days.withColumn("base_date", F.explode(F.sequence(F.date_add("date", low), F.date_add("date", high - 1))))


def event_evidence(net: DataFrame, special: DataFrame) -> DataFrame:
    """(date, name, net, base): volume of each past special day and the clean mean of the 28 days before it.

    Days with fewer than ten clean days before them, or without volume there, say nothing.
    """
    clean = net.join(F.broadcast(special.select("date")), "date", "left_anti").select(F.col("date").alias("base_date"), F.col("net").alias("base_net"))
    base = base_windows(special.select("date", "name")).join(clean, "base_date").groupBy("date", "name").agg(F.avg("base_net").alias("base"), F.count("*").alias("n"))
    return base.filter(f"n >= {EVENT_MIN_OBS} AND base > 0").join(net, "date").select("date", "name", "net", "base")


def special_factors(evidence: DataFrame, cutoffs: DataFrame, mode: str = "drifting") -> DataFrame:
    """(cutoff, name, factor, actual, expected) from evidence up to each cutoff."""
    f = decayed_sums(evidence, ("name",), decaying(F.col("name"), mode), ("net", "base"), cutoffs)
    raw = F.col("net") / F.col("base")
    factor = F.when(F.col("name").startswith("bf"), clip(raw, *BF_FACTOR_CLIP)).otherwise(clip(raw, *FACTOR_CLIP))
    return f.select("cutoff", "name", F.col("net").alias("actual"), F.col("base").alias("expected"), factor.alias("factor"))


def pooled_factor(factors: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, pooled): all types together, clipped; 0.5 without evidence."""
    p = factors.groupBy("cutoff").agg((F.sum("actual") / F.sum("expected")).alias("p"))
    return cutoffs.select("cutoff").join(p, "cutoff", "left").select("cutoff", clip(F.coalesce("p", F.lit(POOLED_DEFAULT)), *FACTOR_CLIP).alias("pooled"))


def damp_pairs(net: DataFrame, special: DataFrame, damp: DataFrame) -> DataFrame:
    """(ord, date, type, net, base_date, base_net, ...): damped days with the clean days of their weekday in their base."""
    clean = net.join(F.broadcast(special.select("date")), "date", "left_anti").select(F.col("date").alias("base_date"), F.col("net").alias("base_net"))
    wide = damp.withColumn("base_date", F.explode(F.expr("sequence(date_add(anchor, span_lo), date_add(anchor, span_hi - 1))")))
    wide = wide.filter(F.weekday("base_date") == F.weekday("date"))
    return wide.join(clean, "base_date").join(net, "date")


def damp_factors(pairs: DataFrame, damp: DataFrame, cutoffs: DataFrame, mode: str = "drifting") -> DataFrame:
    """(cutoff, type, damp): group by group; base days of earlier groups are first divided by their factor.

    The calendar bounds the pairs, so they are one array, of types in the order of their groups, with their days and
    those days' bases. Each cutoff folds it, with the factors so far as the state: no group waits for a job.
    """
    earlier = damp.select(F.col("date").alias("base_date"), F.col("ord").alias("base_ord"), F.col("type").alias("base_type"))
    keys = ["ord", "date", "type", "net", "clip_lo", "clip_hi", "min_obs"]
    of_base = pairs.join(F.broadcast(earlier), "base_date", "left").withColumn("base_type", F.when(F.col("base_ord") < F.col("ord"), F.struct("base_ord", "base_type")))
    of_base = of_base.groupBy(*keys, "base_date", "base_net").agg(F.max("base_type")["base_type"].alias("base_type"))
    of_day = of_base.groupBy(*keys).agg(F.collect_list(F.struct("base_date", "base_net", "base_type")).alias("bases"))
    of_type = of_day.groupBy("ord", "type").agg(F.max("clip_lo").alias("lo"), F.max("clip_hi").alias("hi"), F.sort_array(F.collect_list(F.struct("date", "net", "min_obs", "bases"))).alias("days"))
    ordered = of_type.agg(F.sort_array(F.collect_list(F.struct("ord", "type", "lo", "hi", "days"))).alias("types"))
    zero = F.lit(0.0)

    def mean(values: Column) -> Column:
        return F.aggregate(values, zero, lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))

    def factor(known: Column, t: Column) -> Column:
        """Of one type, from days and base days up to the cutoff; null without any."""

        def day(d: Column) -> Column:
            bases = F.transform(F.filter(d["bases"], lambda b: b["base_date"] <= F.col("cutoff")), lambda b: b["base_net"] / F.coalesce(F.element_at(known, F.coalesce(b["base_type"], F.lit(""))), F.lit(1.0)))
            weight = F.when(decaying(t["type"], mode), decay(F.col("cutoff"), d["date"])).otherwise(1.0)
            return F.struct(F.when(F.size(bases) >= d["min_obs"], mean(bases)).alias("base"), (d["net"] * weight).alias("net"), weight.alias("weight"))

        days = F.filter(F.transform(F.filter(t["days"], lambda d: d["date"] <= F.col("cutoff")), day), lambda d: d["base"] > 0)
        sums = F.aggregate(days, F.struct(zero.alias("net"), zero.alias("base")), lambda a, d: F.struct((a["net"] + d["net"]).alias("net"), (a["base"] + d["base"] * d["weight"]).alias("base")))
        return F.transform(F.array(sums), lambda s: F.least(F.greatest(F.try_divide(s["net"], F.nullif(s["base"], zero)), t["lo"]), t["hi"]))[0]

    def fold(known: Column, t: Column) -> Column:
        found = F.transform(F.array(factor(known, t)), lambda f: F.when(f.isNull(), known).otherwise(F.map_concat(known, F.create_map(t["type"], f))))
        return found[0].cast("map<string,double>")

    folded = cutoffs.select("cutoff").distinct().withColumn("types", ordered.scalar()).filter("types IS NOT NULL")
    return folded.select("cutoff", F.explode(F.aggregate("types", F.expr("CAST(map() AS map<string,double>)"), fold)).alias("type", "damp"))


def day_damp(damp: DataFrame) -> DataFrame:
    """(date, type): the type of each damped day; of several groups the last."""
    return damp.groupBy("date").agg(F.max(F.struct("ord", "type")).alias("m")).select("date", F.col("m.type").alias("type"))


def damp_by_day(damp: DataFrame, factors: DataFrame) -> DataFrame:
    """(cutoff, date, damp) of damped days that have a factor at the cutoff."""
    return F.broadcast(day_damp(damp)).join(factors, "type").select("cutoff", "date", "damp")


def series_multipliers(p: DataFrame, special: DataFrame, factors: DataFrame, cutoffs: DataFrame, split: bool = False, decayed: bool = True) -> DataFrame:
    """(cutoff, series_id, grp, mult): a series' own volume on a group's days against what the factors expect.

    Shrunk towards 1 by 500 shipments on both sides and clipped; xmas groups decay by age.
    """
    days = special.select("date", "name", multiplier_group(F.col("name"), split).alias("grp")).filter("grp IS NOT NULL")
    clean = p.join(F.broadcast(special.select("date")), "date", "left_anti").select(F.col("date").alias("base_date"), "series_id", F.col("y").alias("base_y"))
    base = F.broadcast(base_windows(days)).join(clean, "base_date").groupBy("date", "name", "grp", "series_id").agg(F.avg("base_y").alias("base"), F.count("*").alias("n"))
    e = base.filter(f"n >= {EVENT_MIN_OBS}").join(p, ["date", "series_id"])
    sums = decayed_sums(e, ("series_id", "grp", "name"), (F.col("grp") != "bf") & F.lit(decayed), ("y", "base"), cutoffs)
    m = sums.join(F.broadcast(factors.select("cutoff", "name", "factor")), ["cutoff", "name"])
    m = m.groupBy("cutoff", "series_id", "grp").agg(F.sum("y").alias("a"), F.sum(F.col("base") * F.col("factor")).alias("e"))
    return m.select("cutoff", "series_id", "grp", clip((F.col("a") + SERIES_K) / (F.col("e") + SERIES_K), *SERIES_CLIP).alias("mult"))


def vacation_multipliers(p: DataFrame, special: DataFrame, damp: DataFrame, factors: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, series_id, mult) over all damped days, against clean undamped days in the 28 before their anchor."""
    free = p.join(F.broadcast(special.select("date")), "date", "left_anti").join(F.broadcast(day_damp(damp).select("date")), "date", "left_anti")
    free = free.select(F.col("date").alias("base_date"), "series_id", F.col("y").alias("base_y"))
    anchors = damp.select(F.col("anchor").alias("date")).distinct()
    base = F.broadcast(base_windows(anchors)).join(free, "base_date").groupBy(F.col("date").alias("anchor"), "series_id").agg(F.avg("base_y").alias("base"), F.count("*").alias("n"))
    e = F.broadcast(damp.select("date", "type", "anchor")).join(p, "date").join(base.filter(f"n >= {EVENT_MIN_OBS}"), ["anchor", "series_id"])
    sums = decayed_sums(e, ("series_id", "type"), F.lit(False), ("y", "base"), cutoffs)
    m = sums.join(F.broadcast(factors), ["cutoff", "type"]).groupBy("cutoff", "series_id").agg(F.sum("y").alias("a"), F.sum(F.col("base") * F.col("damp")).alias("e"))
    return m.select("cutoff", "series_id", clip((F.col("a") + SERIES_K) / (F.col("e") + SERIES_K), *VACATION_CLIP).alias("mult"))
