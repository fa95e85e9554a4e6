"""Forecasters as table functions of SQL: they are fed a series' history row by row, in order, and give its forecast.

    SELECT f.* FROM weekday_profile(TABLE(history) PARTITION BY (cutoff, series_id) ORDER BY (date), 14, 4, 42) f

What a function keeps is bounded by its parameters, not by the length of the history.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from quern.operators.rolling import recent
from quern.plans.forecast import Inputs

FORECAST = StructType([StructField("cutoff", DateType()), StructField("series_id", StringType()), StructField("date", DateType()), StructField("yhat", DoubleType())])
HISTORY = {"cutoff": "date", "series_id": "string", "date": "date", "y": None}


def _checked(history: AnalyzeArgument, **numbers: AnalyzeArgument) -> None:
    """Raises for a history without its columns, or for a parameter that is not a whole number above 0."""
    if not history.isTable:
        raise ValueError("the first argument must be a table")
    have = {f.name: f.dataType.simpleString() for f in history.dataType.fields}
    for name, kind in HISTORY.items():
        if name not in have or (kind and have[name] != kind):
            raise ValueError(f"the history needs a column {name}" + (f" of type {kind}" if kind else ""))
    for name, x in numbers.items():
        if not x.isConstantExpression or not isinstance(x.value, int) or x.value < 1:
            raise ValueError(f"{name} must be a whole number above 0, known beforehand")


class _History:
    """What both functions share: whose rows these are, and the days ahead."""

    def __init__(self) -> None:
        self.cutoff: dt.date | None = None
        self.series_id: str | None = None
        self.horizon = 0

    def _seen(self, row: Row, horizon: int) -> None:
        self.cutoff, self.series_id, self.horizon = row["cutoff"], row["series_id"], horizon

    def _ahead(self) -> Iterator[tuple[int, dt.date]]:
        for lead in range(1, self.horizon + 1):
            yield lead, self.cutoff + dt.timedelta(days=lead)


class WeekdayProfile(_History):
    """Mean of the last k values of the weekday within the last `days` days; 0 if there is none."""

    def __init__(self) -> None:
        super().__init__()
        self.last: dict[int, deque] = {}

    @staticmethod
    def analyze(history: AnalyzeArgument, horizon: AnalyzeArgument, k: AnalyzeArgument, days: AnalyzeArgument) -> AnalyzeResult:
        _checked(history, horizon=horizon, k=k, days=days)
        return AnalyzeResult(schema=FORECAST)

    def eval(self, row: Row, horizon: int, k: int, days: int) -> None:
        self._seen(row, horizon)
        if row["cutoff"] - dt.timedelta(days=days) < row["date"] <= row["cutoff"]:
            self.last.setdefault(row["date"].weekday(), deque(maxlen=k)).append(row["y"])

    def terminate(self) -> Iterator[tuple]:
        for _, day in self._ahead():
            values = self.last.get(day.weekday())
            yield self.cutoff, self.series_id, day, sum(values) / len(values) if values else 0.0


class SeasonalNaive(_History):
    """The value of a week before, or of two weeks where that is after the cutoff; 0 if there is none. It partitions and
    orders its table itself."""

    def __init__(self) -> None:
        super().__init__()
        self.week: deque = deque(maxlen=7)

    @staticmethod
    def analyze(history: AnalyzeArgument, horizon: AnalyzeArgument) -> AnalyzeResult:
        _checked(history, horizon=horizon)
        if horizon.value > 14:
            raise ValueError("the horizon is two weeks at most")
        return AnalyzeResult(schema=FORECAST, partitionBy=[PartitioningColumn("cutoff"), PartitioningColumn("series_id")], orderBy=[OrderingColumn("date")])

    def eval(self, row: Row, horizon: int) -> None:
        self._seen(row, horizon)
        if row["date"] <= row["cutoff"]:
            self.week.append((row["date"], row["y"]))

    def terminate(self) -> Iterator[tuple]:
        known = dict(self.week)
        for lead, day in self._ahead():
            yield self.cutoff, self.series_id, day, float(known.get(day - dt.timedelta(days=7 if lead <= 7 else 14)) or 0)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    for name, function in (("weekday_profile", WeekdayProfile), ("seasonal_naive", SeasonalNaive)):
        spark.udtf.register(name, F.udtf(function))


def history(x: Inputs, days: int) -> DataFrame:
    """(cutoff, series_id, date, y): the last `days` days of every series at each cutoff."""
    return recent(x.panel, x.cutoffs, days).select("cutoff", "series_id", "date", F.col("y").cast("long").alias("y"))


def by_sql(x: Inputs, call: str, days: int) -> DataFrame:
    """A forecast by a call of SQL, in which {history} stands for the table of the last `days` days."""
    spark = x.panel.sparkSession
    register(spark)
    view = f"history_{uuid.uuid4().hex}"
    history(x, days).createTempView(view)
    return spark.sql(f"SELECT f.* FROM {call.format(history=f'TABLE({view})')} f")
