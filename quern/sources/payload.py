"""A panel as one text: a header, then a line of counts for each series; sent in slices and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 40_000


def lines(panel: DataFrame, start: str, end: str) -> DataFrame:
    """(series_id, line): the series' name and its counts by day, with commas."""
    p = panel.filter(F.col("date").between(start, end))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "y"))), lambda x: x["y"].cast("string")), ",")
    return p.groupBy("series_id").agg(counts.alias("c")).select("series_id", F.concat_ws(",", "series_id", "c").alias("line"))


def encode(panel: DataFrame, start: str, end: str, version: int = 2) -> DataFrame:
    """One row: payload, its length and MD5. The payload has a line for each series of a bounded catalogue."""
    body = lines(panel, start, end)
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    header = F.concat_ws(",", F.lit(f"v{version}"), F.count("*").cast("string"), days.cast("string"), F.lit(start), F.lit(end))
    out = body.agg(text.alias("t"), header.alias("h")).select(F.concat_ws("\n", "h", "t").alias("payload"))
    return out.select("payload", F.length("payload").alias("len"), F.md5("payload").alias("md5"))


def slices(payload: DataFrame, size: int = SLICE) -> DataFrame:
    """(off, part): slices from 1-based offsets."""
    off = payload.select("payload", F.explode(F.sequence(F.lit(1), F.length("payload"), F.lit(size))).alias("off"))
    return off.select("off", F.substring("payload", F.col("off"), F.lit(size)).alias("part"))


def encode_years(panel: DataFrame, version: int = 2) -> DataFrame:
    """(year, payload, len, md5) of every year of the panel; a payload holds the days of the year that the panel has."""
    p = panel.withColumn("year", F.year("date"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "y"))), lambda x: x["y"].cast("string")), ",")
    body = p.groupBy("year", "series_id").agg(counts.alias("c"), F.min("date").alias("a"), F.max("date").alias("b"))
    head = F.concat_ws(",", F.lit(f"v{version}"), F.count("*").cast("string"), (F.datediff(F.max("b"), F.min("a")) + 1).cast("string"), F.min("a").cast("string"), F.max("b").cast("string"))
    out = body.groupBy("year").agg(head.alias("h"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "series_id", "c"))), "\n").alias("t"))
    out = out.select("year", F.concat_ws("\n", "h", "t").alias("payload"))
    return out.select("year", "payload", F.length("payload").alias("len"), F.md5("payload").alias("md5"))


def slice_years(payloads: DataFrame, size: int = SLICE) -> DataFrame:
    """(year, off, part, len, md5): slices from 1-based offsets, with the length and MD5 of the whole."""
    off = payloads.select("*", F.explode(F.sequence(F.lit(1), F.length("payload"), F.lit(size))).alias("off"))
    return off.select("year", "off", F.substring("payload", F.col("off"), F.lit(size)).alias("part"), "len", "md5")


def reassemble(parts: DataFrame) -> DataFrame:
    """(year, payload) of slices; a missing or repeated slice or a changed one is an error of the job."""
    whole = parts.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("off", "part"))).alias("p"), F.max("len").alias("len"), F.max("md5").alias("md5"))
    text = F.array_join(F.transform("p", lambda x: x["part"]), "")
    whole = whole.select("year", text.alias("payload"), "len", "md5")
    sound = (F.length("payload") == F.col("len")) & (F.md5("payload") == F.col("md5"))
    return whole.select("year", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("slices of a payload do not fit: "), F.col("year").cast("string"))).cast("string")).alias("payload"))


def decode(payload: DataFrame) -> DataFrame:
    """(date, series_id, y) of payloads; a line whose counts are not as many as the header's days is an error."""
    rows = payload.select(F.split("payload", "\n").alias("r")).select(F.split(F.col("r")[0], ",").alias("h"), F.explode(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0)))).alias("line"), (F.size("r") - 1).alias("n"))
    fits = (F.size(F.split("line", ",")) - 1 == F.col("h")[2].cast("int")) & (F.col("n") == F.col("h")[1].cast("int"))
    row = rows.select(F.when(fits, F.split("line", ",")).otherwise(F.raise_error(F.lit("the payload does not fit its header")).cast("array<string>")).alias("v"), F.col("h")[3].cast("date").alias("start"))
    return row.select(F.posexplode(F.slice("v", 2, F.size("v") - 1)), F.col("v")[0].alias("series_id"), "start").select(F.date_add("start", F.col("pos")).alias("date"), "series_id", F.col("col").cast("int").alias("y"))


def reconcile(panel: DataFrame, totals: DataFrame) -> DataFrame:
    """Series whose sum or number of days differs from independent totals (series_id, total, n_days); empty if none."""
    own = panel.groupBy("series_id").agg(F.sum("y").alias("own"), F.count("*").alias("days"))
    both = own.join(totals, "series_id", "full_outer")
    return both.filter(~F.col("own").eqNullSafe(F.col("total")) | ~F.col("days").eqNullSafe(F.col("n_days")))
