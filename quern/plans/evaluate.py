"""One experiment at one stage: lock, cutoffs, forecast, contract, clip, mask, score, record.

A forecaster is a function of Inputs, or a file that defines a class `Forecaster` with
fit_predict(history, cutoff, horizon, series_meta) on pandas frames.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import PanelConfig
from quern.plans import backtest as B
from quern.plans.forecast import Inputs
from quern.plans.trees import ALL as FORECASTERS
from quern.session import discard, written
from quern.sources.files import check_lock
from quern.sources.records import append, run_record

#: A forecaster's file may not name these: it sees the panel only as its history.
FORBIDDEN = ("data/snapshot", "data_snapshot")


def _module(source: str) -> dict:
    names: dict = {"__name__": "forecaster"}
    exec(compile(source, "forecaster", "exec"), names)  # noqa: S102  the user's own file, as an import would run it
    if "Forecaster" not in names:
        raise ValueError("the file must define a class Forecaster")
    return names


def python_forecaster(path: str, pass_meta: bool = True) -> tuple[Callable[[Inputs], DataFrame], dict]:
    """The forecaster of a file, and its PARAMS.

    Each cutoff is a group of its own in applyInPandas: the panel up to it, which the configuration bounds (series by
    days). The source travels with the function, so no executor needs the file.
    """
    source = Path(path).read_text(encoding="utf-8")
    if any(x in source for x in FORBIDDEN):
        raise ValueError("the forecaster reads the snapshot directly")
    params = _module(source).get("PARAMS", {})

    def forecast(x: Inputs) -> DataFrame:
        meta = {"series": [r.asDict() for r in x.series.collect()]} if pass_meta else {}
        horizon = x.horizon

        def run(key: tuple, history: pd.DataFrame) -> pd.DataFrame:
            history = history[["date", "series_id", "y"]].assign(date=pd.to_datetime(history["date"]))
            history = history.sort_values(["date", "series_id"], ignore_index=True)
            got = _module(source)["Forecaster"]().fit_predict(history=history, cutoff=pd.Timestamp(key[0]), horizon=horizon, series_meta=meta)
            out = got[["series_id", "date", "yhat"]].copy()
            out["date"] = pd.to_datetime(out["date"]).dt.date
            return out.assign(cutoff=key[0])[["cutoff", "series_id", "date", "yhat"]]

        known = x.panel.join(F.broadcast(x.cutoffs), F.col("date") <= F.col("cutoff"))
        return known.groupBy("cutoff").applyInPandas(run, "cutoff date, series_id string, date date, yhat double")

    return forecast, params


def backtest(x: Inputs, forecaster: Callable[[Inputs], DataFrame]) -> tuple[DataFrame, int]:
    """(scored cells, number of negative forecasts). A forecast that breaks the contract is refused, and so are cells
    without an actual value."""
    predictions = written(forecaster(x), "predictions")
    clipped = B.check(predictions, x.series, x.targets())
    scored = written(B.scored_cells(predictions, x.panel, x.series), "scored")
    discard(predictions)
    if missing := scored.filter("y IS NULL").count():
        raise ValueError(f"{missing} scored cells have no actual value")
    return scored, clipped


def evaluate(
    x: Inputs,
    config: PanelConfig,
    stage: str,
    forecaster: str | Callable[[Inputs], DataFrame],
    lock: tuple[list[str], str],
    allow_locked: bool = False,
    snapshot_sha: str = "",
    notes: str = "",
    results: tuple[str, str] | None = None,
) -> DataFrame:
    """The run record of a forecaster (a name, a file, or a function) at a stage; the cutoffs of `x` are replaced.

    `lock` is (files of the definition, file of the lock); a run is refused if there is no lock or it does not fit. `results` is where
    the record and the leaderboard's row are appended. History before the stage's train_start is not seen.
    """
    sha = check_lock(*lock)
    days, begun = B.stage_days(config, stage, allow_locked), time.time()
    params: dict = {}
    name = forecaster if isinstance(forecaster, str) else getattr(forecaster, "__name__", "forecaster")
    if isinstance(forecaster, str):
        if forecaster in FORECASTERS:
            forecaster = FORECASTERS[forecaster]
        else:
            forecaster, params = python_forecaster(forecaster)
    start = F.lit(config.stages[stage].train_start).cast("date")
    seen = replace(x, panel=x.panel.filter(F.col("date") >= start), cutoffs=B.cutoffs(x.panel.sparkSession, days))
    scored, clipped = backtest(seen, forecaster)
    run_id = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    record = run_record(scored, run_id, name, stage, round(time.time() - begun, 1), json.dumps(params, sort_keys=True), clipped, sha, snapshot_sha, notes)
    if results:
        append(record, *results)
    return record
