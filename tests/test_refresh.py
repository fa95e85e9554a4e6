"""Refresh of a frozen panel, days that close, and table functions."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from quern.operators.rolling import masked, rolling_levels
from quern.plans import forecast as P
from quern.plans import tablefn as U
from quern.plans.queries import World
from quern.sources import refresh as N
from quern.streaming.daily import closed_daily_counts, daily_event_counts, late_events, open_state


def files_of(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def months_of(files, before):
    return {p.split("month=")[1][:7] for p in files if files[p] != before.get(p)}


def test_a_late_cancellation_changes_its_months_only(spark, tmp_path):
    days = [dt.date(1999, 1, 1) + dt.timedelta(k) for k in range(400)]
    rows = [(d, s, (k * 7 + len(s)) % 11) for k, d in enumerate(days) for s in ("a", "bb")]
    panel = spark.createDataFrame(rows, "date date, series_id string, y int")
    special = spark.createDataFrame([(dt.date(1999, 12, 24), "x")], "date date, name string")
    path = str(tmp_path)
    N.freeze(panel, path, special)
    before = {k: files_of(f"{path}/{k}") for k in ("panel", "levels", "digests")}
    assert N.refresh(panel, path, special).count() == 0
    assert all(files_of(f"{path}/{k}") == v for k, v in before.items())
    late = F.when((F.col("date") == dt.date(1999, 5, 20)) & (F.col("series_id") == "a"), 0).when(F.col("date") == dt.date(1999, 10, 1), 5).otherwise(F.col("y"))
    now = panel.withColumn("y", late.cast("int"))
    changed = {r.date for r in N.refresh(now, path, special).collect()}
    assert changed == {dt.date(1999, 5, 20), dt.date(1999, 10, 1)}
    touched = {k: months_of(files_of(f"{path}/{k}"), before[k]) for k in before}
    assert touched["panel"] == touched["digests"] == {"1999-05", "1999-10"}
    assert touched["levels"] == {"1999-05", "1999-06", "1999-07", "1999-10", "1999-11"}  # 60 days on
    whole = rolling_levels(masked(now, special)).select(*N.LEVELS)
    assert sorted(map(str, N.read_months(spark, f"{path}/levels").select(*N.LEVELS).collect())) == sorted(map(str, whole.collect()))
    assert sorted(N.read_months(spark, f"{path}/panel").select("date", "series_id", "y").collect()) == sorted(now.collect())
    with pytest.raises(ValueError, match="missing"):
        N.refresh(now.filter("date <> DATE '1999-03-03'"), path, special)


def test_only_months_in_question_are_read(spark, tmp_path):
    rows = [(dt.date(1999, 1, 1) + dt.timedelta(k), "a", k) for k in range(300)]
    N.freeze(spark.createDataFrame(rows, "date date, series_id string, y int"), str(tmp_path), spark.createDataFrame([], "date date, name string"))
    df = N.read_months(spark, f"{tmp_path}/panel", F.lit("1999-03-10").cast("date"), F.lit("1999-04-02").cast("date"))
    assert {r.date for r in df.collect()} == {dt.date(1999, 3, 10) + dt.timedelta(k) for k in range(24)}
    assert len({f.split("month=")[1][:7] for f in df.inputFiles()}) <= 10 and "PartitionFilters: [" in df._jdf.queryExecution().executedPlan().toString()


def events(spark, rows, path):
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # files are taken in the order of their times


def test_days_close_once_and_late_events_are_counted_apart(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    counts = {}
    for k, rows in enumerate([
        [(1, "2024-01-01 10:00", "a", 1.0), (2, "2024-01-01 11:00", "a", 2.0), (3, "2024-01-02 10:00", "b", 4.0), (2, "2024-01-01 11:00", "a", 2.0)],
        [(4, "2024-01-05 10:00", "a", 8.0), (5, "2024-01-01 12:00", "a", 16.0)],  # the watermark is at 2023-12-31 10:00
        [(6, "2024-01-01 13:00", "a", 32.0), (7, "2024-01-02 13:00", "a", 64.0), (8, "2024-01-04 13:00", "b", 128.0)],  # at 2024-01-03 10:00
        [(9, "2024-01-20 10:00", "a", 256.0)],
    ]):
        events(spark, rows, source)
        stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(source)
        query = closed_daily_counts(stream).writeStream.outputMode("append").format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        counts[k] = late_events(query), open_state(query)
    got = sorted((r.date.day, r.event_type, r.n, r.total) for r in spark.read.parquet(f"{out}/t").collect())
    assert got == [(1, "a", 3, 19.0), (2, "b", 1, 4.0), (4, "b", 1, 128.0), (5, "a", 1, 8.0)]
    assert [late for late, _ in counts.values()] == [0, 0, 2, 0]
    assert counts[3][1] <= 3  # days that have closed are out of the state


def test_open_days_are_counted_as_they_come(spark, tmp_path):
    events(spark, [(1, "2024-01-01 10:00", "a", 1.0), (2, "2024-02-01 10:00", "a", 2.0)], f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    query = daily_event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("open_days").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.date.month, r.n) for r in spark.table("open_days").collect()} == {(1, 1), (2, 1)}


def test_table_functions_equal_the_plans(spark):
    x = World(spark, "/root/testdata/sf0.001").inputs
    rows = lambda df: sorted((r.cutoff, r.series_id, r.date, round(r.yhat, 9)) for r in df.collect())
    assert rows(U.by_sql(x, "weekday_profile({history} PARTITION BY (cutoff, series_id) ORDER BY (date), 14, 4, 42)", 42)) == rows(P.weekday_profile(x))
    assert rows(U.by_sql(x, "seasonal_naive({history}, 14)", 14)) == rows(P.seasonal_naive(x))
    for call, fault in (("weekday_profile({history} PARTITION BY (cutoff, series_id) ORDER BY (date), 14, 0, 42)", "above 0"), ("seasonal_naive({history}, 20)", "two weeks")):
        with pytest.raises(Exception, match=fault):
            U.by_sql(x, call, 14)
    with pytest.raises(Exception, match="needs a column series_id"):
        spark.sql("SELECT * FROM seasonal_naive(TABLE(SELECT DATE'2000-01-01' AS cutoff, DATE'2000-01-01' AS date, 1 AS y), 14)")
