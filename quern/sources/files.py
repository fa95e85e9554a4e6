"""Readers and writers of panels, catalogues, configurations and captures."""

from __future__ import annotations

import datetime as dt
import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import DEFAULT, PanelConfig, Stage

PANEL = "date DATE, series_id STRING, y INT"
MEMBERSHIP = "core_account_id BIGINT, series_id STRING, rank INT, n_ref INT, name STRING, first_date DATE"
CATALOGUE = "series ARRAY<STRUCT<series_id: STRING, kind: STRING, core_account_id: BIGINT, name: STRING, rank: INT, n_ref: INT, first_date: DATE, member_account_ids: ARRAY<BIGINT>>>"


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Parquet panel with the types of the contract, whatever the file's."""
    raw = spark.read.parquet(path)
    return raw.select(F.col("date").cast("date").alias("date"), F.col("series_id").cast("string").alias("series_id"), F.col("y").cast("int").alias("y"))


def write_panel(df: DataFrame, path: str) -> None:
    """Sorted by day and series over range partitions, zstd. Files of a day follow each other, so dates prune."""
    df.select("date", "series_id", F.col("y").cast("int").alias("y")).repartitionByRange("date", "series_id").sortWithinPartitions("date", "series_id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEMBERSHIP).option("header", True).csv(path)


def write_membership(df: DataFrame, path: str) -> None:
    df.orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, kind, ...) of a catalogue file. Members given as text instead of a list become null."""
    loose = CATALOGUE.replace("member_account_ids: ARRAY<BIGINT>", "member_account_ids: STRING")
    rows = spark.read.schema(loose).option("multiLine", True).json(path).select(F.explode("series").alias("s")).select("s.*")
    return rows.withColumn("member_account_ids", F.from_json("member_account_ids", "array<bigint>"))


def catalogue(member: DataFrame, config: PanelConfig = DEFAULT) -> DataFrame:
    """One row with `series`, an array of all series: customers by rank, tail groups with their accounts, the rest.

    Its size is set by the configuration (the accounts that have a rank).
    """
    fields = ("series_id", "kind", "core_account_id", "name", "rank", "n_ref", "first_date", "member_account_ids")
    none = lambda kind: F.lit(None).cast(kind)
    day = F.lit(config.start).cast("date")
    one = member.filter(F.col("series_id").startswith("c_"))
    one = one.select(F.lit(0).alias("p"), "series_id", F.lit("customer").alias("kind"), F.col("acct").cast("long").alias("core_account_id"), F.col("series_id").alias("name"), "rank", F.col("n_ref").cast("int").alias("n_ref"), "first_date", none("array<bigint>").alias("member_account_ids"))
    many = member.filter(~F.col("series_id").startswith("c_")).groupBy("series_id").agg(F.array_sort(F.collect_list(F.col("acct").cast("long"))).alias("ids"))
    rest = member.sparkSession.createDataFrame([(config.rest,)], "series_id string").select(F.lit(2).alias("p"), "series_id", none("array<bigint>").alias("ids"))
    many = many.select(F.lit(1).alias("p"), "series_id", "ids").unionByName(rest)
    many = many.select("p", "series_id", F.lit("tail_group").alias("kind"), none("bigint").alias("core_account_id"), none("string").alias("name"), none("int").alias("rank"), none("int").alias("n_ref"), day.alias("first_date"), F.col("ids").alias("member_account_ids"))
    every = one.unionByName(many).withColumn("order", F.struct("p", F.coalesce("rank", F.lit(0)), "series_id"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("order", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("series"))


def manifest(panel: DataFrame, payloads: DataFrame, version: int = 2) -> DataFrame:
    """One row: version, totals of the panel, its digest, and length and MD5 of each year's payload (year, len, md5).

    The digest is over the digests of days, so nothing but those meets in one place.
    """
    by_day = panel.groupBy("date").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "series_id", F.col("y").cast("string")))), ";"), 256).alias("h"), F.sum("y").alias("y"), F.count("*").alias("n"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("date").cast("string"), "h"))), ";"), 256)
    years = payloads.agg(F.array_sort(F.collect_list(F.struct("year", "len", "md5"))).alias("years"))
    total = by_day.agg(F.sum("n").alias("rows"), F.sum("y").alias("grand_total"), digest.alias("snapshot_sha"))
    return total.crossJoin(F.broadcast(years)).select(F.lit(version).alias("extract_version"), "*", F.lit(panel.select("series_id").distinct().count()).alias("series"))


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def load_stages(path: str) -> tuple[dict[str, Stage], int]:
    """Stages and horizon of a YAML configuration, read on the driver."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    day = lambda x: x.isoformat() if isinstance(x, dt.date) else str(x)
    stages = {k: Stage(day(v["train_start"]), day(v["first_cutoff"]), day(v["last_cutoff"]), bool(v.get("locked", False))) for k, v in raw["stages"].items()}
    return stages, int(raw["horizon_days"])


MARK = r"/\*SNAP kind=(\w+) y=(\d+)(?: off=(\d+))? v=(\d+)\*/"


def read_captures(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(kind, year, offset, data): captured query results of a version; data are rows of text.

    Each file is JSON with the statement, which carries a mark, and the response, whose text is JSON itself.
    """
    raw = spark.read.schema("tool_input STRUCT<sql: STRING>, tool_response ARRAY<STRUCT<text: STRING>>").option("multiLine", True).json(folder)
    sql = F.col("tool_input.sql")
    part = lambda k: F.regexp_extract(sql, MARK, k)
    rows = raw.filter((part(4) != "") & (part(4).try_cast("int") == version))
    data = F.from_json(F.col("tool_response")[0]["text"], "result_set STRUCT<data: ARRAY<ARRAY<STRING>>>")["result_set"]["data"]
    return rows.select(part(1).alias("kind"), part(2).cast("int").alias("year"), F.when(part(3) != "", part(3).cast("int")).alias("offset"), data.alias("data"))


def exactly_one(df: DataFrame, what: str):
    """The only row; raises if there are none or several."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{what}: expected one row, found {'none' if not rows else 'several'}")
    return rows[0]


def definition_hash(paths: list[str]) -> str:
    """SHA-256 over files' names and contents."""
    h = hashlib.sha256()
    for p in sorted(paths):
        h.update(Path(p).name.encode() + b"\0" + Path(p).read_bytes())
    return h.hexdigest()


def check_lock(paths: list[str], lock: str, write: bool = False) -> str:
    """Compares the definition with the locked hash; raises where they differ or there is none. `write` sets the lock."""
    now, file = definition_hash(paths), Path(lock)
    if write:
        file.write_text(now + "\n")
    elif not file.exists():
        raise FileNotFoundError(f"no lock at {lock}: it has to be written once, on purpose")
    elif file.read_text().strip() != now:
        raise ValueError("the definition has changed since it was locked")
    return now
