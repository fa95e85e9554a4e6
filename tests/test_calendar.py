import datetime as dt

from pyspark.sql import functions as F

from quern.config import PanelConfig
from quern.functions import calendar as C

# Easter, Ascension, Whit Sunday, Black Friday, Monday of ISO week 25
KNOWN = {
    1995: ("1995-04-16", "1995-05-25", "1995-06-04", "1995-11-24", "1995-06-19"),
    1999: ("1999-04-04", "1999-05-13", "1999-05-23", "1999-11-26", "1999-06-21"),
    2001: ("2001-04-15", "2001-05-24", "2001-06-03", "2001-11-23", "2001-06-18"),
    2024: ("2024-03-31", "2024-05-09", "2024-05-19", "2024-11-29", "2024-06-17"),
    2026: ("2026-04-05", "2026-05-14", "2026-05-24", "2026-11-27", "2026-06-15"),
}
CONFIG = PanelConfig(first_year=1995, last_year=2026)


def test_known_days(spark):
    y = F.col("year")
    got = C.years(spark, CONFIG).select("year", C.easter(y), C.black_friday(y), C.iso_monday(y, 25)).collect()
    for year, easter, friday, monday in got:
        if year in KNOWN:
            assert (str(easter), str(friday), str(monday)) == (KNOWN[year][0], KNOWN[year][3], KNOWN[year][4])
    names = {(str(d), n) for d, n in C.holidays(spark, CONFIG).collect()}
    for year, (_, asc, whit, _, _) in KNOWN.items():
        assert (asc, "Kristi himmelfartsdag") in names and (whit, "Pinsedag") in names
        assert any(n == "Store bededag" and d.startswith(str(year)) for d, n in names) == (year <= 2023)


def test_official_name_wins(spark):
    got = {r.date: r.name for r in C.special_days(spark, CONFIG).collect()}
    assert got[dt.date(1995, 6, 5)] == "Anden pinsedag" and got[dt.date(2022, 6, 5)] == "Pinsedag"
    assert got[dt.date(1996, 6, 5)] == "constitution_day" and got[dt.date(1999, 11, 22)] == "bf-4"


def test_edge_distances(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2000-02-01', DATE '2000-02-20')) AS date")
    special = spark.sql("SELECT DATE '2000-02-10' AS date, 'x' AS name UNION ALL SELECT DATE '2000-12-24', 'xmas_eve'")
    got = {r.date.day: (r.to_special, r.since_special) for r in C.edge_distances(days, special).collect()}
    assert got[10] == (0, 0) and got[7] == (3, 10) and got[13] == (10, 3) and got[1] == (9, 10) and got[20] == (10, 10)
