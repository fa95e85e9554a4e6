"""From shipments to a dense panel of daily counts by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT, PanelConfig


def shipments(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """(d, acct): shipments that are neither returned nor cancelled. Both filters reach the scans."""
    sold = lineitem.filter("l_returnflag <> 'R'").select("l_orderkey", F.col("l_shipdate").cast("date").alias("d"), F.col("l_suppkey").alias("acct"))
    live = orders.filter("o_orderstatus <> 'P'").select("o_orderkey")
    return sold.join(live, sold.l_orderkey == live.o_orderkey).select("d", "acct")


def account_days(ship: DataFrame) -> DataFrame:
    """(d, acct, n): shipments of each account and day. All later tables come from this one, so the fact is read once."""
    return ship.groupBy("d", "acct").agg(F.count("*").alias("n"))


def membership(days: DataFrame, config: PanelConfig = DEFAULT) -> DataFrame:
    """(acct, series_id, rank, n_ref, first_date) of the accounts of most shipments in the reference window.

    Ties go to the lesser account. Only as many accounts as have a rank are sorted in one place; their number is set by
    the configuration, so the result may be broadcast.
    """
    within = F.when(F.col("d").between(config.ref_start, config.ref_end), F.col("n")).otherwise(0)
    volume = days.groupBy("acct").agg(F.sum(within).alias("n_ref"), F.min("d").alias("first_date"))
    leading = volume.filter("n_ref > 0").orderBy(F.desc("n_ref"), "acct").limit(max(config.ranked, config.top))
    ranked = leading.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_ref"), "acct")))
    name = F.when(F.col("rank") <= config.top, F.concat(F.lit("c_"), F.col("acct").cast("string")))
    for bound, band in config.bands:
        name = name.when(F.col("rank") <= bound, band)
    return ranked.select("acct", name.alias("series_id"), "rank", "n_ref", "first_date")


def daily_counts(days: DataFrame, member: DataFrame, config: PanelConfig = DEFAULT) -> DataFrame:
    """(date, series_id, cnt) from (d, acct, n). The membership may be a given one; accounts outside it are the rest."""
    named = days.filter(F.col("d").between(config.start, config.end)).join(F.broadcast(member.select("acct", "series_id")), "acct", "left")
    return named.groupBy(F.col("d").alias("date"), F.coalesce("series_id", F.lit(config.rest)).alias("series_id")).agg(F.sum("n").alias("cnt"))


def spine(spark: SparkSession, config: PanelConfig = DEFAULT) -> DataFrame:
    """All days of the panel."""
    return spark.sql(f"SELECT explode(sequence(DATE '{config.start}', DATE '{config.end}')) AS date")


def series(member: DataFrame, config: PanelConfig = DEFAULT) -> DataFrame:
    """(series_id, kind, first_date): customers from their first shipment on, tail groups and the rest from the start."""
    spark = member.sparkSession
    named = member.select("series_id", "first_date").union(spark.sql(f"SELECT '{config.rest}', DATE '{config.start}'"))
    kind = F.when(F.col("series_id").startswith("c_"), "customer").otherwise("tail_group")
    first = F.when(kind == "customer", F.col("first_date")).otherwise(F.to_date(F.lit(config.start)))
    return named.select("series_id", kind.alias("kind"), first.alias("first_date")).distinct()


def dense(days: DataFrame, names: DataFrame, daily: DataFrame) -> DataFrame:
    """(date, series_id, y): a row for each day and series, 0 where nothing was shipped.

    The days are few and known beforehand; they are the broadcast side of the product.
    """
    grid = names.select("series_id").crossJoin(F.broadcast(days))
    return grid.join(daily, ["date", "series_id"], "left").select("date", "series_id", F.coalesce("cnt", F.lit(0)).cast("int").alias("y"))


def network(p: DataFrame) -> DataFrame:
    """(date, net): all series together."""
    return p.groupBy("date").agg(F.sum("y").alias("net"))
