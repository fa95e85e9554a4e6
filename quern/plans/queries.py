"""The registered queries: each takes (spark, sf_dir) and returns a table; `ORACLE` has their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import DEFAULT, PanelConfig
from quern.functions import calendar as C
from quern.functions import metrics as M
from quern.operators import events as E
from quern.operators import features as X
from quern.operators import ingest as I
from quern.operators import rolling as R
from quern.plans import backtest as B
from quern.plans import forecast as P
from quern.plans import tablefn as U
from quern.plans.evaluate import evaluate
from quern.plans import trees as T
from quern.plans.oracle import ORACLE as ORACLE
from quern.session import local, shared_dir, ship, table, written
from quern.sources import captures as K
from quern.sources import files as S
from quern.sources import payload as Y
from quern.sources import records as Z
from quern.sources import refresh as N
from quern.streaming.daily import closed_daily_counts, daily_event_counts

PAYLOAD = ("2000-01-01", "2000-12-31")
SLICE = 4_000


class World:
    """Tables of one input folder. The panel, which all estimates read many times, is written once; the membership and the
    calendars, whose size the configuration sets, are rows within the plans."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: PanelConfig = DEFAULT, dates: tuple | None = None):
        ship(spark)  # for tree models, table functions and data sources, which run in Python workers
        self.spark, self.dir, self.config = spark, sf_dir, config
        self.dates = dates or config.cutoffs

    @cached_property
    def ship(self) -> DataFrame:
        return I.shipments(table(self.spark, self.dir, "lineitem"), table(self.spark, self.dir, "orders"))

    @cached_property
    def account_days(self) -> DataFrame:
        return written(I.account_days(self.ship), "account-days")

    @cached_property
    def member(self) -> DataFrame:
        return local(I.membership(self.account_days, self.config))

    @cached_property
    def series(self) -> DataFrame:
        return I.series(self.member, self.config)

    @cached_property
    def daily(self) -> DataFrame:
        return I.daily_counts(self.account_days, self.member, self.config)

    @cached_property
    def panel(self) -> DataFrame:
        return written(I.dense(I.spine(self.spark, self.config), self.series, self.daily), "panel")

    @cached_property
    def special(self) -> DataFrame:
        return local(C.special_days(self.spark, self.config))

    @cached_property
    def damp(self) -> DataFrame:
        return local(C.damp_days(self.spark, self.config))

    @cached_property
    def cutoffs(self) -> DataFrame:
        return B.cutoffs(self.spark, self.dates)

    @cached_property
    def inputs(self) -> P.Inputs:
        return P.Inputs(self.panel, self.series, self.cutoffs, self.special, lambda: self.damp, self.config.horizon, lambda: C.day_types(self.spark, self.config))

    @cached_property
    def factors(self) -> DataFrame:
        return E.special_factors(E.event_evidence(self.inputs.net, self.special), self.cutoffs)

    @cached_property
    def damp_factors(self) -> DataFrame:
        return E.damp_factors(E.damp_pairs(self.inputs.net, self.special, self.damp), self.damp, self.cutoffs)

    @cached_property
    def shape(self) -> DataFrame:
        return R.weekday_shape(self.inputs.clean, self.cutoffs)

    @cached_property
    def features(self) -> DataFrame:
        span = I.spine(self.spark, self.config)
        edges = C.edge_distances(span.union(span.select(F.date_add("date", 30))).distinct(), self.special)
        return X.feature_rows(self.panel, self.special, C.day_types(self.spark, self.config), edges, self.cutoffs.select(F.col("cutoff").alias("ref")), self.config.horizon)

    def scored(self, name: str = "weekday_profile") -> DataFrame:
        return B.scored_cells(T.ALL[name](self.inputs), self.panel, self.series)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, so that the order of sums does not show."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_QUERIES: dict[str, Callable[[World], DataFrame]] = {
    "shipments_fact": lambda w: w.ship,
    "membership_rank": lambda w: w.member,
    "series_bands": lambda w: w.series,
    "daily_counts": lambda w: w.daily,
    "dense_panel": lambda w: w.panel,
    "series_totals": lambda w: w.panel.groupBy("series_id").agg(F.sum("y").alias("total"), F.count("*").alias("n_days"), F.max("date").alias("last_date")),
    "yearly_totals": lambda w: w.panel.groupBy(F.year("date").alias("year")).agg(F.sum("y").alias("total"), F.countDistinct("series_id").alias("n_series"), F.count("*").alias("n_rows")),
    "network_daily": lambda w: I.network(w.panel),
    "panel_files": lambda w: _round_trip(w, "panel"),
    "first_active": lambda w: R.first_active(w.panel),
    "payload_lines": lambda w: Y.lines(w.panel, *PAYLOAD),
    "payload_md5": lambda w: Y.encode(w.panel, *PAYLOAD).select("len", "md5"),
    "payload_slices": lambda w: Y.slices(Y.encode(w.panel, *PAYLOAD), SLICE),
    "payload_roundtrip": lambda w: Y.decode(Y.encode(w.panel, *PAYLOAD)),
    "payload_years": lambda w: Y.encode_years(w.panel).select("year", "len", "md5"),
    "payload_reassembled": lambda w: Y.decode(Y.reassemble(Y.slice_years(Y.encode_years(w.panel)))),
    "membership_csv": lambda w: _round_trip(w, "csv"),
    "catalogue_json": lambda w: _round_trip(w, "json"),
    "manifest": lambda w: S.manifest(w.panel, Y.encode_years(w.panel)).select("extract_version", "rows", "grand_total", "series", "snapshot_sha", F.size("years").alias("n_years"), F.element_at("years", 1)["md5"].alias("first_md5")),
    "reconcile": lambda w: Y.reconcile(w.panel, w.panel.groupBy("series_id").agg((F.sum("y") + F.when(F.col("series_id") == "g5_tail", 1).otherwise(0)).alias("total"), F.count("*").alias("n_days"))),
    "holidays": lambda w: C.holidays(w.spark, w.config),
    "special_days": lambda w: w.special,
    "black_friday": lambda w: C.years(w.spark, w.config).select("year", C.black_friday(F.col("year")).alias("date")),
    "damp_calendar": lambda w: w.damp.select("ord", "grp", "date", "type", "anchor"),
    "day_types": lambda w: C.day_types(w.spark, w.config),
    "edge_distances": lambda w: C.edge_distances(I.spine(w.spark, w.config), w.special),
    "clean_days": lambda w: w.inputs.clean,
    "masked_days": lambda w: R.masked(w.panel, w.special),
    "weekday_profile": lambda w: R.last_weekday_mean(w.panel, w.cutoffs, 4, 42),
    "clean_profile": lambda w: R.last_weekday_mean(w.inputs.clean, w.cutoffs, 4),
    "weekday_shape": lambda w: w.shape,
    "weekday_shape_6": lambda w: R.weekday_shape(w.inputs.clean, w.cutoffs, 6),
    "deflated_level": lambda w: P.levels(w.inputs, w.shape, None, False).select("cutoff", "series_id", "level"),
    "special_level": lambda w: R.special_level(w.inputs.clean, w.cutoffs),
    "event_evidence": lambda w: E.event_evidence(w.inputs.net, w.special),
    "special_factors": lambda w: E.special_factors(E.event_evidence(w.inputs.net, w.special), w.cutoffs, "none"),
    "recency_factors": lambda w: w.factors,
    "recency_factors_all": lambda w: E.special_factors(E.event_evidence(w.inputs.net, w.special), w.cutoffs, "all"),
    "pooled_factor": lambda w: E.pooled_factor(w.factors, w.cutoffs),
    "damp_factors": lambda w: w.damp_factors,
    "series_multipliers": lambda w: E.series_multipliers(w.panel, w.special, w.factors, w.cutoffs),
    "series_multipliers_split": lambda w: E.series_multipliers(w.panel, w.special, w.factors, w.cutoffs, split=True),
    "vacation_multipliers": lambda w: E.vacation_multipliers(w.panel, w.special, w.damp, w.damp_factors, w.cutoffs),
    "step_level": lambda w: P.levels(w.inputs, w.shape, E.damp_by_day(w.damp, w.damp_factors)),
    "bf_informed_level": lambda w: P.bf_informed_level(w.inputs),
    "trend_growth": lambda w: P.levels(w.inputs, w.shape, E.damp_by_day(w.damp, w.damp_factors), False).select("cutoff", "series_id", P.trend_growth().alias("growth")),
    "rolling_levels": lambda w: R.rolling_levels(R.masked(w.panel, w.special)).select("date", "series_id", "l7", "l28", "l56"),
    "level_cascade": lambda w: R.rolling_levels(R.masked(w.panel, w.special)).select("date", "series_id", "l14_raw", "l14"),
    "active_share": lambda w: R.rolling_levels(R.masked(w.panel, w.special)).select("date", "series_id", "active_60"),
    "lag_features": lambda w: w.features,
    "training_refs": lambda w: X.training_refs(w.panel, w.cutoffs),
    "training_labels": lambda w: X.labelled(w.features).select("ref", "series_id", "lead", "label", "weight"),
    "seasonal_naive": lambda w: P.seasonal_naive(w.inputs),
    "profile_forecast": lambda w: P.weekday_profile(w.inputs),
    "profile_by_sql": lambda w: U.by_sql(w.inputs, "weekday_profile({history} PARTITION BY (cutoff, series_id) ORDER BY (date), 14, 4, 42)", 42),
    "naive_by_sql": lambda w: U.by_sql(w.inputs, "seasonal_naive({history}, 14)", 14),
    "holiday_forecast": lambda w: P.holiday_profile(w.inputs),
    "shape_level_forecast": lambda w: P.shape_level(w.inputs),
    "hand_forecast": lambda w: P.hand(w.inputs),
    "trend_forecast": lambda w: P.hand(w.inputs, trend=True),
    "vacation_forecast": lambda w: P.hand(w.inputs, vacation=True),
    "burstiness": lambda w: R.burstiness(w.inputs.clean, w.cutoffs),
    "blend_weights": lambda w: P.blend_weights(w.inputs),
    "blend_half": lambda w: P.blend([(P.seasonal_naive(w.inputs), 0.5), (P.weekday_profile(w.inputs), 0.5)]),
    "blend_thirds": lambda w: P.blend([(part(w.inputs), 1 / 3) for part in (P.seasonal_naive, P.weekday_profile, P.holiday_profile)]),
    "blend_forecast": lambda w: P.bursty_blend(w.inputs, P.shape_level(w.inputs), P.seasonal_naive(w.inputs), P.weekday_profile(w.inputs)),
    "scored_cells": lambda w: w.scored(),
    "metric_summary": lambda w: M.summary(w.scored()),
    "metric_slices": lambda w: M.slices(w.scored()),
    "per_cutoff": lambda w: M.per_cutoff(w.scored()),
    "worst_series": lambda w: M.worst_series(w.scored()),
    "network_wmape": lambda w: M.network_wmape(w.scored()),
    "contract_checks": lambda w: B.contract(P.seasonal_naive(w.inputs).filter("NOT (series_id = 'g5_tail' AND date = DATE '1999-01-12')"), w.series, w.inputs.targets()),
    "leaderboard_row": lambda w: Z.leaderboard_row(Z.run_record(w.scored(), "run", "weekday_profile", "six", 0.0)).select("run_id", "experiment", "wmape", "network_wmape", "bias", "n_cells", "n_series", "n_cutoffs"),
    "run_record": lambda w: _flat_record(Z.run_record(w.scored(), "run", "weekday_profile", "six", 0.0)),
}


def _round_trip(w: World, kind: str) -> DataFrame:
    """The panel as Parquet, the membership as CSV, or the catalogue as JSON, written to the shared folder and read back."""
    path = f"{shared_dir(w.spark)}/quern-{kind}-{uuid.uuid4().hex}"
    if kind == "panel":
        S.write_panel(w.panel, path)
        return S.read_panel(w.spark, path)
    if kind == "csv":
        S.write_membership(w.member.select(F.col("acct").alias("core_account_id"), "series_id", "rank", "n_ref", F.col("series_id").alias("name"), "first_date"), path)
        return S.read_membership(w.spark, path)
    S.write_json(S.catalogue(w.member, w.config), path)
    got = S.read_catalogue(w.spark, path)
    return got.select("series_id", "kind", "core_account_id", "rank", "n_ref", "first_date", F.size("member_account_ids").alias("n_members"))


def _flat_record(record: DataFrame) -> DataFrame:
    """A record with its two arrays as text."""
    text = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(f(x) for f in parts))), ",").alias(c)
    six = lambda k: lambda x: F.format_string("%.6f", x[k])
    plain = lambda k: lambda x: x[k].cast("string")
    flat = [c for c, t in record.dtypes if not t.startswith("array")]
    return record.select(*flat, text("per_cutoff", plain("cutoff"), six("wmape"), six("bias"), plain("n_series")), text("worst_series", plain("series_id"), six("wmape"), plain("volume"), six("bias")))


def evaluate_stage1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator on the first stage: lock, contract, clip, mask, score, record. The lock is that of a file that is
    written here, as there is no definition in the input folder."""
    w = World(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        definition, lock = f"{folder}/stages.txt", f"{folder}/lock"
        Path(definition).write_text(repr(DEFAULT))
        S.check_lock([definition], lock, write=True)
        record = evaluate(w.inputs, DEFAULT, "stage1", "weekday_profile", ([definition], lock))
    flat = [c for c in Z.LEADERBOARD if c not in ("run_id", "runtime_s", "eval_sha", "notes")]
    return rounded(record.select(*flat))


def _small(query: Callable[[World], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(query(World(spark, sf_dir)))


def stage_backtest(spark: SparkSession, sf_dir: str, stage: str = "stage1", forecaster: str = "weekday_profile") -> DataFrame:
    """All cutoffs of a stage in one plan: metrics by cutoff."""
    w = World(spark, sf_dir, dates=tuple(B.stage_days(DEFAULT, stage)))
    return rounded(M.per_cutoff(w.scored(forecaster)))


def gbt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree forecasts of absolute loss at all cutoffs of the configuration, in the model's last form."""
    return rounded(T.gradient_boosted(World(spark, sf_dir).inputs))


def tree_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cutoff, series_id, date, l1, l2, thirds, full): both tree heads and their two blends with the hand-made one."""
    x = World(spark, sf_dir).inputs
    hand = written(P.hand(x), "head")
    l1, l2 = (written(head, "head") for head in T.heads(x, T.FIRST))
    out = None
    for name, df in (("l1", l1), ("l2", l2), ("thirds", P.blend([(part, 1 / 3) for part in (hand, l1, l2)])), ("full", P.bursty_blend(x, hand, l1, l2))):
        one = df.select("cutoff", "series_id", "date", F.col("yhat").alias(name))
        out = one if out is None else out.join(one, ["cutoff", "series_id", "date"])
    return rounded(out)


def full_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend of the hand-made head and two tree heads, of absolute and squared loss, by burstiness."""
    return rounded(T.full_blend(World(spark, sf_dir).inputs, T.FIRST))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A folder or a file of its name: the stream reads all that matches.
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path if _is_folder(spark, path) else f"{sf_dir}/event[s].parquet")


def streamed_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the events read as a stream of files, after all of them."""
    counted = daily_event_counts(_event_stream(spark, sf_dir))
    out = f"{shared_dir(spark)}/quern-stream-{uuid.uuid4().hex}"
    store = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table")
    counted.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(counted.schema).parquet(f"{out}/table"))


def closed_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the days that have closed once all events have been read, appended as they close."""
    counted = closed_daily_counts(_event_stream(spark, sf_dir))
    out = f"{shared_dir(spark)}/quern-stream-{uuid.uuid4().hex}"
    counted.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(counted.schema).parquet(f"{out}/table"))


def refreshed(spark: SparkSession, sf_dir: str) -> tuple[str, World]:
    """A panel frozen before some orders were cancelled, and brought up to date since: its folder."""
    w = World(spark, sf_dir)
    later = (F.col("o_orderdate") >= "1998-01-01") & (F.pmod("o_orderkey", F.lit(3)) == 0)
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(later, "O").otherwise(F.col("o_orderstatus")))
    early = I.account_days(I.shipments(table(spark, sf_dir, "lineitem"), orders))
    before = I.dense(I.spine(spark, w.config), w.series, I.daily_counts(early, w.member, w.config))
    path = f"{shared_dir(spark)}/quern-frozen-{uuid.uuid4().hex}"
    N.freeze(before, path, w.special)
    N.refresh(w.panel, path, w.special)
    return path, w


def panel_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel after a refresh: as if it had been built anew."""
    return N.read_months(spark, f"{refreshed(spark, sf_dir)[0]}/panel").select("date", "series_id", "y")


def levels_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels after a refresh."""
    return rounded(N.read_months(spark, f"{refreshed(spark, sf_dir)[0]}/levels").select("date", "series_id", "l7", "l28", "l56"))


def captures_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel from its payload's slices, each captured as a query's result: written under their hashes, read back by
    kind and version, put together and checked."""
    w = World(spark, sf_dir)
    slices = Y.slice_years(Y.encode_years(w.panel))
    mark = F.format_string("SELECT 1 /*SNAP kind=slice y=%d off=%d v=2*/", "year", "off")
    result = F.to_json(F.struct(F.struct(F.array(F.array(*(F.col(c).cast("string") for c in ("part", "len", "md5")))).alias("data")).alias("result_set")))
    capture = F.to_json(F.struct(F.struct(mark.alias("sql")).alias("tool_input"), F.array(F.struct(result.alias("text"))).alias("tool_response")))
    path = f"{shared_dir(spark)}/quern-captures-{uuid.uuid4().hex}"
    K.save_payloads(slices.select(capture.alias("payload")), path)
    read = K.captures(spark, path).filter("kind = 'slice' AND version = 2")
    one = F.element_at("data", 1)
    return Y.decode(Y.reassemble(read.select("year", F.col("part").alias("off"), one[0].alias("part"), one[1].cast("int").alias("len"), one[2].alias("md5"))))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _small(q) for name, q in _QUERIES.items()}
QUERIES |= {
    "evaluate_stage1": evaluate_stage1,
    "stage1_backtest": stage_backtest,
    "stage3_hand_backtest": lambda spark, sf_dir: stage_backtest(spark, sf_dir, "stage3", "hand"),
    "stage1_gbt_backtest": lambda spark, sf_dir: stage_backtest(spark, sf_dir, "stage1", "gbt_first"),
    "gbt_forecast": gbt_forecast,
    "tree_blends": tree_blends,
    "full_blend": full_blend,
    "streamed_daily_events": streamed_daily_events,
    "closed_daily_events": closed_daily_events,
    "panel_refreshed": panel_refreshed,
    "levels_refreshed": levels_refreshed,
    "captures_round_trip": captures_round_trip,
}
