"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ("membership_rank", "dense_panel", "payload_md5", "special_days", "damp_calendar", "day_types", "edge_distances", "weekday_shape", "special_factors", "rolling_levels", "holiday_forecast", "metric_summary", "worst_series", "contract_checks", "payload_reassembled", "catalogue_json", "membership_csv", "manifest", "run_record", "profile_by_sql", "naive_by_sql", "damp_factors", "series_multipliers", "closed_daily_events", "panel_refreshed", "captures_round_trip")


def rows(names, values):
    at = sorted(range(len(names)), key=lambda k: names[k])
    def cell(v):
        if v is None or v != v:
            return "-"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v[k]) for k in at) for v in values)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 6
