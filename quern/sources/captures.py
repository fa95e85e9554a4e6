"""Captured query results and the leaderboard as data sources of Spark.

`captures` reads a folder of JSON files, a partition a file. Filters on kind, year, part and version are pushed to it:
a file whose mark they exclude is skipped before its JSON is parsed. `payload_sink` writes payloads under the hash of
their content: tasks write under temporary names, and the commit gives each its name if that is not taken yet, so
writers at the same time, repeated tasks and repeated runs leave each payload once. `leaderboard` appends rows to one
CSV file whose header is there from the moment the file is.

Paths are those of a file system that driver and executors share and mount (file:// or plain).
"""

from __future__ import annotations

import contextlib
import csv
import hashlib
import io
import json
import os
import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

MARK = re.compile(r"/\*SNAP kind=(\w+) y=(\d+)(?: off=(\d+))? v=(\d+)\*/")
CAPTURE = "kind string, year int, part int, version int, data array<array<string>>"
_FIELDS = ("kind", "year", "part", "version")
_LOCK = threading.Lock()


def local_path(path: str) -> str:
    """The mounted folder or file of a path; refuses other schemes."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a mounted path: {path}")
    return unquote(parts.path) if parts.scheme else path


@dataclass
class Capture(InputPartition):
    path: str


class CaptureReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.wanted = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities and lists of values of the mark's fields; the others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in _FIELDS:
                self.wanted.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in ("kind", "year", "version")):  # these never are null
                yield f

    def partitions(self) -> list[Capture]:
        return [Capture(os.path.join(self.folder, n)) for n in sorted(os.listdir(self.folder)) if n.endswith(".json")]

    def mark(self, text: str) -> dict | None:
        """The fields of the first mark in a file's text; none without one, or where a filter excludes it."""
        found = MARK.search(text)
        if not found:
            return None
        kind, year, part, version = found.groups()
        mark = {"kind": kind, "year": int(year), "part": None if part is None else int(part), "version": int(version)}
        return mark if all(mark[name] in values for name, values in self.wanted) else None

    def read(self, partition: Capture) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            text = f.read()
        if (mark := self.mark(text.replace("\\/", "/"))) is None:
            return
        whole = json.loads(text)
        if not MARK.search((whole.get("tool_input") or {}).get("sql") or ""):
            return  # the mark is elsewhere than in the statement
        answers = whole.get("tool_response") or [{}]
        result = json.loads(answers[0].get("text") or "{}").get("result_set") or {}
        data = [[None if v is None else str(v) for v in row] for row in result.get("data") or []]
        yield *(mark[name] for name in _FIELDS), data


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURE

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(local_path(self.options["path"]))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PayloadWriter(DataSourceWriter):
    """The first column's texts, each in a file `result_<hash>.json`."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for row in iterator:
            content = (row[0] or "").encode()
            temporary = os.path.join(self.folder, f".{uuid.uuid4().hex}.tmp")
            with open(temporary, "wb") as f:
                f.write(content)
            files.append((temporary, os.path.join(self.folder, f"result_{hashlib.sha1(content).hexdigest()[:16]}.json")))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        for temporary, final in (pair for m in messages if m for pair in m.files):
            with contextlib.suppress(FileExistsError):  # the same content is there already
                os.link(temporary, final)
            os.unlink(temporary)

    def abort(self, messages: list[Written | None]) -> None:
        for temporary, _ in (pair for m in messages if m for pair in m.files):
            with contextlib.suppress(FileNotFoundError):
                os.unlink(temporary)


class PayloadSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload_sink"

    def writer(self, schema: StructType, overwrite: bool) -> PayloadWriter:
        if overwrite:
            raise ValueError("payloads are only added")
        return PayloadWriter(local_path(self.options["path"]))


@dataclass
class Lines(WriterCommitMessage):
    text: str


class LeaderboardWriter(DataSourceWriter):
    """Rows come with the tasks' messages (a run has one) and are appended by one write."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _text(self, rows: Iterator) -> str:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        return out.getvalue()

    def write(self, iterator: Iterator[Row]) -> Lines:
        return Lines(self._text(iterator))

    def commit(self, messages: list[Lines | None]) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        if not os.path.exists(self.path):
            temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
            with open(temporary, "w", encoding="utf-8") as f:
                f.write(self._text(iter([self.columns])))
            with contextlib.suppress(FileExistsError):
                os.link(temporary, self.path)
            os.unlink(temporary)
        rows = "".join(m.text for m in messages if m).encode()
        file = os.open(self.path, os.O_WRONLY | os.O_APPEND)
        try:
            os.write(file, rows)
        finally:
            os.close(file)

    def abort(self, messages: list[Lines | None]) -> None:
        """Nothing has been written before a commit."""


class LeaderboardSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leaderboard"

    def writer(self, schema: StructType, overwrite: bool) -> LeaderboardWriter:
        if overwrite:
            raise ValueError("the leaderboard is only appended to")
        return LeaderboardWriter(local_path(self.options["path"]), schema.names)


def register(spark: SparkSession) -> None:
    """Makes the sources known to a session, once."""
    with _LOCK:
        if not getattr(spark, "_quern_sources", False):
            for source in (CaptureSource, PayloadSink, LeaderboardSink):
                spark.dataSource.register(source)
            spark._quern_sources = True
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, year, part, version, data) of the captures of a folder; filters on the first four skip files."""
    register(spark)
    return spark.read.format("captures").load(folder)


def save_payloads(df: DataFrame, folder: str, column: str = "payload") -> None:
    """Adds the payloads that are not there yet. Repeats are dropped before anything is written."""
    register(df.sparkSession)
    df.select(column).distinct().write.format("payload_sink").mode("append").save(folder)


def append_leaderboard(rows: DataFrame, path: str) -> None:
    """Appends rows to a leaderboard, which is made with its header if it is not there."""
    register(rows.sparkSession)
    rows.select(*(rows[c].cast("string") for c in rows.columns)).write.format("leaderboard").mode("append").save(path)
