"""Calendar dimensions: holidays, special days, damped weeks, day types, distances to special days.

All of them are small tables of a few rows a day of the covered years; their size is set by the years.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT, EDGE_CAP, PanelConfig

# Official holidays as days from Easter Sunday.
EASTER_HOLIDAYS = (
    (-3, "Skærtorsdag"),
    (-2, "Langfredag"),
    (0, "Påskedag"),
    (1, "Anden påskedag"),
    (26, "Store bededag"),
    (39, "Kristi himmelfartsdag"),
    (49, "Pinsedag"),
    (50, "Anden pinsedag"),
)
FIXED_HOLIDAYS = ((1, 1, "Nytårsdag"), (12, 25, "Juledag"), (12, 26, "Anden juledag"))
#: General Prayer Day was a holiday until this year.
LAST_PRAYER_DAY = 2023
EXTRA_DAYS = ((12, 24, "xmas_eve"), (12, 31, "nye"), (6, 5, "constitution_day"))
BF_OFFSETS = range(-4, 4)
XMAS_DAYS = (20, 21, 22, 23, 27, 28, 29, 30)
XMAS_NAMES = ("xmas_eve", "nye", "Juledag", "Anden juledag", "Nytårsdag")
RUNUP_BLOCKS = ((11, 28, 12, 5, "runup_w3"), (12, 6, 12, 12, "runup_w2"), (12, 13, 12, 19, "runup_w1"))
WINTER_WEEKS, SUMMER_WEEKS, AUTUMN_WEEKS = (7, 8), tuple(range(25, 33)), (41, 42, 43)
#: Group, clip of its factors, base as days from the anchor (end exclusive), least observations; in order of work.
DAMP_GROUPS = (
    ("jan", 0.9, 1.6, 7, 21, 1),
    ("win", 0.5, 1.3, -28, 0, 2),
    ("asc", 0.5, 1.3, -28, 0, 2),
    ("sum", 0.5, 1.3, -28, 0, 2),
    ("aut", 0.5, 1.3, -28, 0, 2),
    ("runup", 0.8, 2.0, -28, 0, 2),
)


def years(spark: SparkSession, config: PanelConfig = DEFAULT) -> DataFrame:
    return spark.range(config.first_year, config.last_year + 1, 1, 1).select(F.col("id").cast("int").alias("year"))


def feasts(spark: SparkSession, config: PanelConfig = DEFAULT) -> DataFrame:
    """(year, easter, bf): the days that others are counted from. A row a year of the configuration, so that they are
    computed first and what follows is a small plan."""
    rows = years(spark, config).select("year", easter(F.col("year")).alias("easter"), black_friday(F.col("year")).alias("bf")).collect()
    return spark.createDataFrame(rows, "year int, easter date, bf date").coalesce(1)


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the anonymous computus."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    ll = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * ll, 451)
    t = h + ll - 7 * m + 114
    return F.make_date(year, div(t, 31), t % 31 + 1)


def black_friday(year: Column) -> Column:
    """The day after the fourth Thursday of November."""
    first = F.make_date(year, F.lit(11), F.lit(1))
    return F.date_add(first, (F.lit(10) - F.weekday(first)) % 7 + 22)


def iso_monday(year: Column, week: Column | int) -> Column:
    """Monday of an ISO week."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(fourth, 7 * ((F.lit(week) if isinstance(week, int) else week) - 1) - F.weekday(fourth))


def _named(rows: list[Column]) -> Column:
    return F.explode(F.array(*rows))


def holidays(spark: SparkSession, config: PanelConfig = DEFAULT) -> DataFrame:
    """(date, name) of official holidays."""
    y = feasts(spark, config)
    row = lambda d, n: F.struct(d.alias("date"), F.lit(n).alias("name"))
    moving = [row(F.date_add("easter", k), n) for k, n in EASTER_HOLIDAYS]
    fixed = [row(F.make_date("year", F.lit(m), F.lit(d)), n) for m, d, n in FIXED_HOLIDAYS]
    out = y.select("year", _named(moving + fixed).alias("h")).select("year", "h.*")
    return out.filter((F.col("name") != "Store bededag") | (F.col("year") <= LAST_PRAYER_DAY)).select("date", "name")


def special_days(spark: SparkSession, config: PanelConfig = DEFAULT) -> DataFrame:
    """(date, name): of several names of a day the first of holiday, bridge, fixed day, Black Friday week, Christmas."""
    y = feasts(spark, config)
    row = lambda p, d, n: F.struct(F.lit(p).alias("p"), d.alias("date"), F.lit(n).alias("name"))
    more = [row(2, F.date_add("easter", 40), "ascension_bridge")]
    more += [row(3, F.make_date("year", F.lit(m), F.lit(d)), n) for m, d, n in EXTRA_DAYS]
    more += [row(4, F.date_add("bf", k), f"bf{k:+d}") for k in BF_OFFSETS]
    more += [row(5, F.make_date("year", F.lit(12), F.lit(d)), f"dec{d:02d}") for d in XMAS_DAYS]
    rest = y.select(_named(more).alias("h")).select("h.*")
    every = holidays(spark, config).select(F.lit(1).alias("p"), "date", "name").unionByName(rest)
    return every.groupBy("date").agg(F.min(F.struct("p", "name")).alias("m")).select("date", F.col("m.name").alias("name"))


def _damp_rows(spark: SparkSession, config: PanelConfig) -> DataFrame:
    """(ord, date, type, anchor) of all groups, before special days are taken out."""
    year = F.col("year")

    def span(order: int, start: Column, days: int, kind: str, anchor: Column) -> Column:
        return F.struct(F.lit(order).alias("ord"), start.alias("start"), F.lit(days).alias("days"), F.lit(kind).alias("type"), anchor.alias("anchor"))

    january, ascension = F.make_date(year, F.lit(1), F.lit(2)), F.date_add("easter", 36)
    spans = [span(0, january, 7, "jan_wk1", january)]
    spans += [span(2, F.date_add(ascension, 7 * w), 7, f"asc_wk{w}", ascension) for w in range(3)]
    for order, weeks, name in ((1, WINTER_WEEKS, "win"), (3, SUMMER_WEEKS, "sum"), (4, AUTUMN_WEEKS, "aut")):
        spans += [span(order, iso_monday(year, w), 7, f"{name}_wk{w}", iso_monday(year, weeks[0])) for w in weeks]
    for m1, d1, m2, d2, name in RUNUP_BLOCKS:
        days = (dt.date(2001, m2, d2) - dt.date(2001, m1, d1)).days + 1
        spans.append(span(5, F.make_date(year, F.lit(m1), F.lit(d1)), days, name, F.date_add("bf", -4)))
    out = feasts(spark, config).select(_named(spans).alias("s")).select("s.*")
    return out.select("ord", F.explode(F.sequence(F.col("start"), F.date_add("start", F.col("days") - 1))).alias("date"), "type", "anchor")


def damp_days(spark: SparkSession, config: PanelConfig = DEFAULT) -> DataFrame:
    """(ord, grp, date, type, anchor, clip_lo, clip_hi, span_lo, span_hi, min_obs), without special days.

    Summer gives way to the weeks around Ascension.
    """
    rows = _damp_rows(spark, config).join(F.broadcast(special_days(spark, config).select("date")), "date", "left_anti")
    asc = rows.filter("ord = 2").select("date", F.lit(True).alias("in_asc")).distinct()
    rows = rows.join(F.broadcast(asc), "date", "left").filter("ord <> 3 OR in_asc IS NULL").drop("in_asc")
    names = ("grp", "clip_lo", "clip_hi", "span_lo", "span_hi", "min_obs")
    groups = spark.createDataFrame([(k, *g) for k, g in enumerate(DAMP_GROUPS)], "ord int, grp string, clip_lo double, clip_hi double, span_lo int, span_hi int, min_obs int")
    return rows.join(F.broadcast(groups), "ord").select("ord", "grp", "date", "type", "anchor", *names[1:])


def day_types(spark: SparkSession, config: PanelConfig = DEFAULT) -> DataFrame:
    """(date, day_type) of days that are not normal: special names first, then jan, asc, win, sum, aut, runup."""
    rank = {0: 1, 2: 2, 1: 3, 3: 4, 4: 5, 5: 6}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("ord")]
    every = special_days(spark, config).select("date", F.lit(0).alias("p"), F.col("name").alias("t"))
    every = every.unionByName(_damp_rows(spark, config).select("date", order.alias("p"), F.col("type").alias("t")))
    return every.groupBy("date").agg(F.min(F.struct("p", "t")).alias("m")).select("date", F.col("m.t").alias("day_type"))


def edge_distances(days: DataFrame, special: DataFrame, cap: int = EDGE_CAP) -> DataFrame:
    """(date, to_special, since_special): days to the next and since the last special day, at most `cap`.

    Christmas (from December 20) and New Year's Day do not count. A day meets the special days within the cap by an
    equi-join on expanded dates, so nothing is sorted in one place.
    """
    month, day = F.month("date"), F.dayofmonth("date")
    edges = special.filter(~(((month == 12) & (day >= 20)) | ((month == 1) & (day == 1)))).select("date").distinct()
    near = edges.select(F.explode(F.sequence(F.date_add("date", -cap), F.date_add("date", cap))).alias("d"), F.col("date").alias("s"))
    gap = F.datediff("s", "d")
    near = near.groupBy(F.col("d").alias("date")).agg(F.min(F.when(gap >= 0, gap)).alias("t"), F.min(F.when(gap <= 0, -gap)).alias("p"))
    return days.select("date").join(near, "date", "left").select("date", F.coalesce("t", F.lit(cap)).alias("to_special"), F.coalesce("p", F.lit(cap)).alias("since_special"))


def drifting(name: Column) -> Column:
    """Types whose response changes from year to year: those of the turn of the year."""
    return name.startswith("dec") | name.startswith("runup") | (name == "jan_wk1") | name.isin(*XMAS_NAMES)


def multiplier_group(name: Column, split: bool = False) -> Column:
    """bf or xmas, or null; split: bf, dec_wind (up to Christmas Eve) and dec_lull (after)."""
    bf = F.when(name.startswith("bf"), "bf")
    if not split:
        return bf.when(name.startswith("dec") | name.isin(*XMAS_NAMES), "xmas")
    wind, lull = ("dec20", "dec21", "dec22", "dec23", "xmas_eve"), ("dec27", "dec28", "dec29", "dec30", "nye", "Nytårsdag", "Juledag", "Anden juledag")
    return bf.when(name.isin(*wind), "dec_wind").when(name.isin(*lull), "dec_lull")
