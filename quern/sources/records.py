"""Run records and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.sources.captures import append_leaderboard


def run_record(scored: DataFrame, run_id: str, experiment: str, stage: str, runtime_s: float, params: str = "{}", clipped_cells: int = 0, eval_sha: str = "", snapshot_sha: str = "", notes: str = "") -> DataFrame:
    """One row: metrics, per_cutoff and worst_series as arrays of structs. Both arrays are small by construction.

    clipped_cells counts negative forecasts that became 0, of all series. The hashes are cut to 16 characters.
    """
    per = M.per_cutoff(scored).agg(F.array_sort(F.collect_list(F.struct("cutoff", "wmape", "bias", "n_series"))).alias("per_cutoff"))
    worst = M.worst_series(scored).agg(F.collect_list(F.struct("series_id", "wmape", "volume", "bias")).alias("worst_series"))
    one = M.summary(scored).crossJoin(F.broadcast(M.slices(scored).drop("wmape"))).crossJoin(F.broadcast(M.network_wmape(scored)))
    one = one.crossJoin(F.broadcast(per)).crossJoin(F.broadcast(worst))
    head = [F.lit(v).alias(k) for k, v in (("run_id", run_id), ("experiment", experiment), ("stage", stage), ("runtime_s", runtime_s), ("params", params), ("clipped_cells", clipped_cells), ("eval_sha", eval_sha[:16]), ("snapshot_sha", snapshot_sha[:16]), ("notes", notes))]
    return one.select(*head, "*")


#: Columns of the leaderboard, in order.
LEADERBOARD = (
    "run_id", "experiment", "stage", "wmape", "mae", "rmse", "bias", "wmape_lead_1_7", "wmape_lead_8_14", "wmape_customers", "wmape_tail",
    "network_wmape", "n_cells", "n_series", "n_cutoffs", "clipped_cells", "runtime_s", "eval_sha", "notes",
)


def leaderboard_row(record: DataFrame) -> DataFrame:
    """The leaderboard's columns of a record, doubles as text of 6 decimals."""
    doubles = {c for c, t in record.dtypes if t == "double"}
    return record.select(*(F.format_string("%.6f", c).alias(c) if c in doubles else F.col(c) for c in LEADERBOARD))


def append(record: DataFrame, runs: str, leaderboard: str) -> None:
    """Appends the record as JSON to a folder that Spark commits, and its row to the one CSV file of the leaderboard."""
    record.write.mode("append").json(runs)
    append_leaderboard(leaderboard_row(record), leaderboard)


def read_leaderboard(spark, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(*LEADERBOARD)
