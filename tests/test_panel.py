import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quern.functions import metrics as M
from quern.operators import events as E
from quern.operators import rolling as R
from quern.plans import backtest as B
from quern.plans import forecast as P
from quern.plans.queries import World
from quern.sources import files, payload

SF = "/root/testdata/sf0.001"


def scored(spark, rows):
    return spark.createDataFrame(rows, "series_id string, kind string, cutoff date, date date, lead int, y int, yhat double")


def test_metrics(spark):
    d = dt.date(2000, 1, 3)
    cells = [("a", "customer", d, d + dt.timedelta(1 + k % 2), 1 + k % 2, y, f) for k, (y, f) in enumerate([(10, 12.0), (0, 1.0), (20, 15.0), (30, 30.0)])]
    r = M.summary(scored(spark, cells)).first()
    assert (round(r.wmape, 9), r.mae, round(r.rmse, 9), round(r.bias, 9)) == (round(8 / 60, 9), 2.0, round(math.sqrt(7.5), 9), round(-2 / 60, 9))
    assert round(M.network_wmape(scored(spark, cells)).first()[0], 9) == round(4 / 60, 9)
    none = M.summary(scored(spark, [("a", "customer", d, d, 1, 0, 1.0)])).first()
    assert none.wmape is None and none.bias is None


def test_clipped_multiplier(spark):
    rows = spark.createDataFrame([(1500.0, 500.0), (0.0, 0.0), (10000.0, 0.0)], "a double, e double")
    got = [r[0] for r in rows.select(E.clip((F.col("a") + 500) / (F.col("e") + 500), 0.2, 3.0)).collect()]
    assert got == [2.0, 1.0, 3.0]


def test_short_windows_fall_back(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(k) for k in range(28)]
    rows = [(d, "a", 7, 7 if k in range(7) or k in (20, 21, 22) else None) for k, d in enumerate(days)]
    got = R.rolling_levels(spark.createDataFrame(rows, "date date, series_id string, y int, y_clean int")).orderBy("date").collect()[-1]
    assert got.l14_raw is None and got.l28 == 7.0 and got.l14 == 7.0


def test_step_and_level_windows(spark):
    """A jump of 20 percent snaps the level to the last week, one of 19 percent does not."""
    cut = dt.date(2000, 3, 6)
    for recent, expected in ((120, 120.0), (119, (119 + 100) / 2)):
        rows = [(cut - dt.timedelta(k), "a", recent if k < 7 else 100) for k in range(14)]
        panel = spark.createDataFrame(rows, "date date, series_id string, y int")
        shape = spark.createDataFrame([(cut, "a", w, 1.0) for w in range(7)], "cutoff date, series_id string, weekday int, shape double")
        special = spark.createDataFrame([], "date date, name string")
        x = P.Inputs(panel, panel.select("series_id").distinct(), B.cutoffs(spark, [cut]), special, None)
        assert P.levels(x, shape, None).first().level == pytest.approx(expected)
    wide = spark.createDataFrame([(cut - dt.timedelta(k), "a", k) for k in range(60)], "date date, series_id string, y int")
    assert R.special_level(wide, B.cutoffs(spark, [cut])).first().special_level == 14.0  # 29 days, 0 to 28


def test_later_days_change_nothing(spark):
    """Forecasts of a cutoff are the same on a panel that ends at it."""
    w = World(spark, SF, dates=("1999-05-10",))
    for f in (P.seasonal_naive, P.hand):
        whole = {(r.series_id, r.date): r.yhat for r in f(w.inputs).collect()}
        past = P.Inputs(w.panel.filter("date <= DATE '1999-05-10'"), w.series, w.cutoffs, w.special, w.damp)
        assert whole == pytest.approx({(r.series_id, r.date): r.yhat for r in f(past).collect()})


def test_partition_adds_up(spark):
    w = World(spark, SF)
    assert w.panel.agg(F.sum("y")).first()[0] == w.ship.filter(F.col("d").between(w.config.start, w.config.end)).count()
    assert w.panel.count() == w.series.count() * 2500


def test_contract(spark):
    w = World(spark, SF, dates=("1999-05-10",))
    f = P.seasonal_naive(w.inputs).filter("series_id <> 'x'")
    assert B.check(f, w.series, w.inputs.targets()) == 0
    one = f.limit(1)
    with pytest.raises(ValueError, match="n_repeated"):
        B.check(f.unionByName(one), w.series, w.inputs.targets())
    with pytest.raises(ValueError, match="n_missing"):
        B.check(f.filter("date <> DATE '1999-05-12'"), w.series, w.inputs.targets())
    with pytest.raises(ValueError, match="n_null"):
        B.check(f.withColumn("yhat", F.lit(None).cast("double")), w.series, w.inputs.targets())
    with pytest.raises(ValueError):
        B.mondays("1999-05-11", "1999-05-17")
    with pytest.raises(PermissionError):
        B.stage_days(w.config, "holdout")


def test_payload(spark, tmp_path):
    text = "v2,2,3,2021-01-01,2021-01-03\na,1,2,3\nb,0,0,4"
    df = spark.createDataFrame([(text,)], "payload string")
    assert payload.decode(df).count() == 6
    whole = df.select(F.lit(2021).alias("year"), "payload", F.length("payload").alias("len"), F.lit("04ee072dacabf9c5928f8e87fa4dee7d").alias("md5"))
    parts = payload.slice_years(whole, 10)
    assert parts.count() == 5 == payload.slices(df, 10).count() and payload.reassemble(parts).first().payload == text
    for changed in (parts.filter("off <> 11"), parts.withColumn("md5", F.lit("0" * 32))):
        with pytest.raises(Exception, match="do not fit"):
            payload.reassemble(changed).collect()
    with pytest.raises(Exception, match="does not fit"):
        payload.decode(spark.createDataFrame([(text.replace("a,1,2,3", "a,1,2"),)], "payload string")).collect()
    panel = payload.decode(df)
    files.write_panel(panel, str(tmp_path / "p"))
    assert sorted(files.read_panel(spark, str(tmp_path / "p")).collect()) == sorted(panel.collect())


def test_captures_and_config(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    for k, v in ((1, 2), (2, 1)):
        (folder / f"{k}.json").write_text('{"tool_input": {"sql": "SELECT 1 /*SNAP kind=slice y=2021 off=1 v=%d*/"}, "tool_response": [{"text": "{\\"result_set\\": {\\"data\\": [[\\"x\\"]]}}"}]}' % v)
    (folder / "3.json").write_text('{"tool_input": {"sql": "SELECT 2"}, "tool_response": []}')
    row = files.exactly_one(files.read_captures(spark, str(folder), 2), "slice")
    assert (row.kind, row.year, row.offset, row.data) == ("slice", 2021, 1, [["x"]])
    with pytest.raises(ValueError):
        files.exactly_one(files.read_captures(spark, str(folder), 9), "slice")
    y = tmp_path / "s.yaml"
    y.write_text("horizon_days: 14\nstages:\n  a: {train_start: 2021-01-01, first_cutoff: 2022-01-03, last_cutoff: 2022-12-19}\n")
    stages, horizon = files.load_stages(str(y))
    assert horizon == 14 and stages["a"].first_cutoff == "2022-01-03" and not stages["a"].locked
    lock = tmp_path / "lock"
    files.check_lock([str(y)], str(lock), write=True)
    files.check_lock([str(y)], str(lock))
    y.write_text("changed")
    with pytest.raises(ValueError):
        files.check_lock([str(y)], str(lock))


def test_registered_trees_train_on_all_references(spark, monkeypatch):
    from quern.plans import queries as Q
    from quern.plans import trees as T

    class Stop(Exception):
        pass

    seen = []

    def rows(panel, special, day_type, edges, refs, horizon):
        seen.append({r.ref for r in refs.select("ref").distinct().collect()})
        raise Stop

    monkeypatch.setattr(T, "feature_rows", rows)
    for query in (Q.gbt_forecast, Q.full_blend):
        with pytest.raises(Stop):
            query(spark, SF)
    world = Q.World(spark, SF)
    want = {r.ref for r in Q.X.training_refs(world.panel, world.cutoffs).collect()}
    assert len(want) > 417 and seen == [want | {dt.date.fromisoformat(d) for d in world.dates}] * 2


def small_inputs(spark):
    """Two series of a weekly pattern over 300 days, one cutoff, no special days."""
    start, cut = dt.date(1999, 1, 4), dt.date(1999, 9, 27)
    rows = [(start + dt.timedelta(k), s, scale * (10 + 5 * (k % 7))) for k in range(300) for s, scale in (("a", 1), ("b", 3))]
    panel = spark.createDataFrame(rows, "date date, series_id string, y int")
    series = spark.createDataFrame([(s, "customer", start) for s in "ab"], "series_id string, kind string, first_date date")
    special = spark.createDataFrame([(dt.date(1998, 12, 25), "Juledag")], "date date, name string")
    return P.Inputs(panel, series, B.cutoffs(spark, [cut]), special, None), cut


def test_trees_learn_a_weekly_pattern(spark):
    """Features by hand, and the trees' error against the pattern's."""
    from quern.operators import features as X
    from quern.operators.boosting import Boosting
    from quern.plans.trees import gradient_boosted

    x, cut = small_inputs(spark)
    types = spark.createDataFrame([], "date date, day_type string")
    with pytest.raises(ValueError):
        gradient_boosted(x)
    x = replace(x, types=types)
    got = gradient_boosted(x, Boosting(rounds=40, leaves=15, step=0.2)).collect()
    actual = {(r.series_id, r.date): r.y for r in x.panel.collect()}
    assert len(got) == 28
    assert sum(abs(r.yhat - actual[r.series_id, r.date]) for r in got) < 0.15 * sum(actual[r.series_id, r.date] for r in got)
    days = x.panel.select("date").distinct()
    edges = days.select("date", F.lit(10).alias("to_special"), F.lit(10).alias("since_special"))
    one = next(r for r in X.feature_rows(x.panel, x.special, types, edges, x.cutoffs.select(F.col("cutoff").alias("ref"))).collect() if (r.series_id, r.lead) == ("b", 9))
    level = sum(actual["b", cut - dt.timedelta(k)] for k in range(14)) / 14
    assert one.base == pytest.approx(level) and one.l7_ratio == pytest.approx(1.0)
    assert one.lag0_ratio == pytest.approx(actual["b", cut - dt.timedelta(5)] / level) and one.actual == actual["b", cut + dt.timedelta(9)]
    old = X.labelled(spark.createDataFrame([(cut - dt.timedelta(730), 10.0, 20)], "ref date, base double, actual int"), F.lit(cut)).first()
    assert old.weight == pytest.approx(10 * 0.5 ** (730 / 365.25)) and old.label == 2.0


MODEL = """
import pandas as pd
PARAMS = {"weeks": 1}
class Forecaster:
    def fit_predict(self, history, cutoff, horizon, series_meta):
        assert history["date"].max() == cutoff and len(series_meta["series"]) == 2
        last = history[history["date"] > cutoff - pd.Timedelta(days=7)]
        out = [(r.series_id, r.date + pd.Timedelta(days=7 * k), r.y - SHIFT) for r in last.itertuples() for k in (1, 2)]
        return pd.DataFrame(out, columns=["series_id", "date", "yhat"])
"""


def test_evaluator(spark, tmp_path):
    from quern.config import PanelConfig, Stage
    from quern.plans.evaluate import evaluate
    from quern.sources import records as Z

    x, cut = small_inputs(spark)
    stages = {"one": Stage("1999-02-01", cut.isoformat(), "1999-10-04"), "holdout": Stage("1999-02-01", cut.isoformat(), cut.isoformat(), locked=True)}
    config = PanelConfig(start="1999-01-04", end="1999-10-30", stages=stages)
    model, lock, results = tmp_path / "model.py", tmp_path / "lock", (str(tmp_path / "runs"), str(tmp_path / "board.csv"))
    fits = [str(tmp_path / "stages.txt")], str(tmp_path / "stages.lock")
    (tmp_path / "stages.txt").write_text("one")
    files.check_lock(*fits, write=True)
    with pytest.raises(TypeError):
        evaluate(x, config, "one", "seasonal_naive")
    model.write_text(MODEL.replace("SHIFT", "0"))
    with pytest.raises(FileNotFoundError):
        evaluate(x, config, "one", "seasonal_naive", ([str(model)], str(lock)))
    assert not lock.exists()
    files.check_lock([str(model)], str(lock), write=True)
    own = evaluate(x, config, "one", str(model), ([str(model)], str(lock)), notes="n", results=results).first()
    named = evaluate(x, config, "one", "seasonal_naive", ([str(model)], str(lock)), results=results).first()
    assert (own.wmape, own.n_cells, own.n_cutoffs, own.clipped_cells) == (0.0, 56, 2, 0) == (named.wmape, named.n_cells, named.n_cutoffs, named.clipped_cells)
    assert own.params == '{"weeks": 1}' and len(own.eval_sha) == 16
    board = Z.read_leaderboard(spark, results[1]).orderBy("experiment").collect()
    assert [r.experiment for r in board] == [str(model), "seasonal_naive"] and spark.read.json(results[0]).count() == 2
    model.write_text(MODEL.replace("SHIFT", "30"))
    with pytest.raises(ValueError, match="changed"):
        evaluate(x, config, "one", str(model), ([str(model)], str(lock)))
    assert evaluate(x, config, "one", str(model), fits).first().clipped_cells == 16
    with pytest.raises(PermissionError):
        evaluate(x, config, "holdout", "seasonal_naive", fits)
    with pytest.raises(ValueError, match="unknown"):
        evaluate(x, config, "two", "seasonal_naive", fits)
    with pytest.raises(ValueError, match="no actual"):
        evaluate(replace(x, panel=x.panel.filter("date <> DATE '1999-10-05'")), config, "one", lambda i: P.seasonal_naive(x.__class__(x.panel, i.series, i.cutoffs, i.special, None)), fits)
    model.write_text("import os  # data/snapshot\nclass Forecaster: pass\n")
    with pytest.raises(ValueError, match="snapshot"):
        evaluate(x, config, "one", str(model), fits)


def test_train_start_hides_older_days(spark, tmp_path):
    from quern.config import PanelConfig, Stage
    from quern.plans.evaluate import evaluate

    x, cut = small_inputs(spark)
    seen = []
    fits = [str(tmp_path / "stages.txt")], str(tmp_path / "stages.lock")
    (tmp_path / "stages.txt").write_text("s")
    files.check_lock(*fits, write=True)

    def spy(i):
        seen.append(i.panel.agg(F.min("date")).first()[0])
        return P.seasonal_naive(i)

    evaluate(x, PanelConfig(end="1999-10-30", stages={"s": Stage("1999-05-03", cut.isoformat(), cut.isoformat())}), "s", spy, fits)
    assert seen == [dt.date(1999, 5, 3)]


def test_fact_is_scanned_once(spark):
    w = World(spark, SF)
    plan = w.account_days._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan
    for df in (w.member, w.series, w.daily, w.panel):
        assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()


def test_history_is_not_joined_with_all_later_cutoffs(spark):
    """Estimates as of a cutoff are read by equality."""
    w = World(spark, SF)
    special, damp = w.special, w.damp
    factors = w.factors
    for df in (R.weekday_shape(w.inputs.clean, w.cutoffs), factors, w.damp_factors, E.series_multipliers(w.panel, special, factors, w.cutoffs), E.vacation_multipliers(w.panel, special, damp, w.damp_factors, w.cutoffs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of(spark):
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(k)
    rows = spark.createDataFrame([("a", day(0), 1), ("a", day(5), 2), ("a", day(5), 3), ("b", day(40), 4), ("c", None, 5)], "k string, date date, v int")
    cutoffs = B.cutoffs(spark, [day(4), day(5), day(30)])
    got = sorted((r.k, r.cutoff, r.v) for r in R.as_of(rows, ("k",), cutoffs).collect())
    assert [x[:2] for x in got] == [("a", day(4)), ("a", day(5)), ("a", day(30))] and got[0][2] == 1 and got[1][2] == got[2][2] in (2, 3)
    assert R.as_of(rows, ("k",), cutoffs.limit(0)).count() == 0


def test_slices_of_all_years(spark):
    w = World(spark, SF)
    parts = payload.slice_years(payload.encode_years(w.panel), 4000)
    assert payload.decode(payload.reassemble(parts)).count() == w.panel.count()
    with pytest.raises(Exception, match="do not fit"):
        payload.reassemble(parts.filter("NOT (year = 1997 AND off = 1)")).collect()


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from quern import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    Session.conf = type("C", (), {"get": lambda self, k, d=None: d})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
