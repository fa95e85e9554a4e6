"""Data sources: captures with pushed filters, payloads under their hash, one leaderboard."""

import csv
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quern.sources import captures as C


def capture(kind, year, version, data, part=None):
    mark = f"/*SNAP kind={kind} y={year}{'' if part is None else f' off={part}'} v={version}*/"
    return json.dumps({"tool_input": {"sql": f"SELECT 1 {mark}"}, "tool_response": [{"text": json.dumps({"result_set": {"data": data}})}]})


@pytest.fixture
def folder(spark, tmp_path):
    texts = [capture("slice", 2021, 2, [["a", 1], [None, "é"]], k) for k in range(3)] + [capture("totals", 2021, 2, []), capture("slice", 2020, 1, [["old"]], 0)]
    C.save_payloads(spark.createDataFrame([(t,) for t in texts * 2], "payload string").repartition(4), f"file://{tmp_path}/c")
    return f"{tmp_path}/c"


def test_round_trip_with_pushed_filters(spark, folder):
    assert len([n for n in os.listdir(folder)]) == 5 and all(n.startswith("result_") for n in os.listdir(folder))
    with open(f"{folder}/result_broken.json", "w") as f:
        f.write("{ not JSON /*SNAP kind=slice y=1999 v=2*/")
    with open(f"{folder}/result_other.json", "w") as f:
        f.write(json.dumps({"tool_input": {"sql": "SELECT 2"}, "tool_response": [{"text": "/*SNAP kind=slice y=2021 v=2*/"}]}))
    df = C.captures(spark, folder).filter("version = 2 AND year IN (2020, 2021) AND kind = 'slice'")
    got = sorted((r.kind, r.year, r.part, r.version, [list(x) for x in r.data]) for r in df.collect())
    assert got == [("slice", 2021, k, 2, [["a", "1"], [None, "é"]]) for k in range(3)]  # the broken file was not parsed
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan captures" in plan and "Filter (" not in plan  # all was pushed
    some = C.captures(spark, folder).filter("year = 2021 AND part > 0 AND version = 2").select("part").collect()
    assert sorted(r.part for r in some) == [1, 2]
    with pytest.raises(Exception, match="JSON|Expecting|broken|SNAP|property"):
        C.captures(spark, folder).collect()


def test_a_pushed_filter_skips_a_file_before_it_is_parsed(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = C.CaptureReader(folder)
    left = list(reader.pushFilters([EqualTo(("version",), 1), GreaterThan(("year",), 1), EqualTo(("data",), None)]))
    assert len(left) == 2
    parsed, loads = [], C.json.loads
    C.json.loads = lambda text: parsed.append(1) or loads(text)
    try:
        rows = [r for p in reader.partitions() for r in reader.read(p)]
    finally:
        C.json.loads = loads
    assert [r[:4] for r in rows] == [("slice", 2020, 0, 1)] and len(parsed) == 2  # the file, and the text within


def test_two_writers_at_once_leave_each_payload_once(spark, tmp_path):
    texts = [(json.dumps({"k": k}),) for k in range(40)]

    def save(_):
        writer = C.PayloadWriter(f"{tmp_path}/p")
        writer.commit([writer.write(iter(texts[k::5])) for k in range(5)])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(save, range(8)))
    C.save_payloads(spark.createDataFrame(texts, "payload string").repartition(5), f"{tmp_path}/p")
    names = os.listdir(f"{tmp_path}/p")
    assert len(names) == 40 and not any(n.endswith(".tmp") for n in names)
    assert {open(f"{tmp_path}/p/{n}").read() for n in names} == {json.dumps({"k": k}) for k in range(40)}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    writer = C.PayloadWriter(f"{tmp_path}/p")
    messages = [writer.write(iter([("a",), ("b",)])), None]
    assert len(os.listdir(f"{tmp_path}/p")) == 2
    writer.abort(messages)
    assert os.listdir(f"{tmp_path}/p") == []
    for path in ("s3://bucket/x", "hdfs://host/x"):
        with pytest.raises(ValueError):
            C.local_path(path)
    with pytest.raises(Exception, match="only added"):
        spark.createDataFrame([("a",)], "payload string").write.format("payload_sink").mode("overwrite").save(f"{tmp_path}/q")


def test_leaderboard_has_one_header(spark, tmp_path):
    path = f"{tmp_path}/deep/leaderboard.csv"

    def run(k):
        writer = C.LeaderboardWriter(path, ["run_id", "wmape"])
        writer.commit([writer.write(iter([(f"run, {k}", f"{k / 3:.6f}")])), None])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, range(6)))
    for k in (6, 7):
        C.append_leaderboard(spark.range(1).select(F.lit(f"run, {k}").alias("run_id"), F.format_string("%.6f", F.lit(k / 3)).alias("wmape")), path)
    with open(path, newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == ["run_id", "wmape"] and sorted(rows[1:]) == sorted([f"run, {k}", f"{k / 3:.6f}"] for k in range(8))
    assert os.listdir(f"{tmp_path}/deep") == ["leaderboard.csv"]
