"""Order MinHash fingerprints.

The k-mers of a text get an occurrence number, so that repeats count. For each of `tuples` hash functions the two
numbered k-mers of least hash are taken, put back into their order in the text, and hashed together. Unlike a plain
MinHash, a fingerprint changes when parts of a text change places; it follows edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import written

K, TUPLES = 8, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Numbers of the matrix of hashes that are held at once.
CELLS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of an array, sorted. (np.unique hashes; for numbers that hardly repeat sorting is faster.)"""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@lru_cache(maxsize=4)
def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-mers of code points, in order; a shorter text is one k-mer, an empty one has none."""
    if not len(points):
        return np.empty(0, np.uint64)
    have, width = points.astype(np.uint64) + np.uint64(1), 1
    k = min(k, len(points))
    parts = {1: have}
    while width * 2 <= k:  # windows of twice the width from two of the width
        b = parts[width]
        parts[2 * width] = b[:-width] * np.uint64(pow(int(_BASE), width, 1 << 64)) + b[width:]
        width *= 2
    out, used = parts[width], width
    for w in sorted(parts, reverse=True):
        while used + w <= k:
            n = len(points) - (used + w) + 1
            out = out[:n] * np.uint64(pow(int(_BASE), w, 1 << 64)) + parts[w][used : used + n]
            used += w
    return mix(out)


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many equal ones stand before it)."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return h
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    some = np.flatnonzero(twice[at] == h)
    order = some[np.argsort(h[some], kind="stable")]
    same = np.concatenate([[False], h[order[1:]] == h[order[:-1]]])
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    again = (np.arange(len(order)) - begin).astype(np.uint64)
    out = h.copy()  # first ones stay as they are, so a repeat elsewhere does not change them
    out[order] = np.where(again > 0, mix(h[order] + again * _BASE), h[order])
    return out


def signature(h: np.ndarray, tuples: int = TUPLES) -> np.ndarray:
    """The fingerprint as numbers, from the k-mers' hashes in text order. All zero for no k-mers."""
    n = len(h)
    if not n:
        return np.zeros(tuples, np.uint32)
    v, a = numbered(h), multipliers(tuples)
    first, second = np.empty(tuples, np.int64), np.empty(tuples, np.int64)
    step = max(1, CELLS // n)
    for t in range(0, tuples, step):
        grid = a[t : t + step, None] * v[None, :]
        rows = np.arange(len(grid))
        first[t : t + step] = one = grid.argmin(axis=1)
        if n > 1:
            grid[rows, one] = np.iinfo(np.uint64).max
            second[t : t + step] = grid.argmin(axis=1)
        else:
            second[t : t + step] = one
    left, right = h[np.minimum(first, second)], h[np.maximum(first, second)]
    return (mix(left * _BASE + mix(right)) >> np.uint64(32)).astype(np.uint32)


def text_hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples."""
    return float(np.mean(a == b))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprint(text: str | None, k: int = K, tuples: int = TUPLES) -> str:
    """Fingerprint of one text (null: as the empty text)."""
    return text_hex(signature(kmers(code_points(text or ""), k), tuples))


class _Doc:
    def __init__(self, doc_id, text: str):
        self.id, self.text = doc_id, text
        self.sig = signature(kmers(code_points(text)))

    def against(self, after: _Doc) -> tuple:
        """The row of this document when `after` is the next one."""
        n = len(self.text)
        edited = self.text[: n - n // 3] + after.text[: n // 3]
        sig = signature(kmers(code_points(edited)))
        return (self.id, n, hashlib.sha256(edited.encode()).hexdigest(), text_hex(self.sig), text_hex(sig), likeness(self.sig, sig), likeness(self.sig, after.sig))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
_NAMES = [*(x.split()[0] for x in _OUT.split(", ")), "shard", "side", "text"]
WHOLE, HEAD, TAIL = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents of a partition but the last, and the texts at both of its ends."""
    shard, held = TaskContext.get().partitionId(), None
    for b in batches:
        rows = []
        for i, t in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
            doc = _Doc(i, t.as_py())
            if held is None:
                rows.append((i, None, None, None, None, None, None, shard, HEAD, doc.text))
            else:
                rows.append((*held.against(doc), shard, WHOLE, None))
            held = doc
        if rows:
            yield _batch(rows)
    if held is not None:
        yield _batch([(held.id, None, None, None, None, None, None, shard, TAIL, held.text)])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the ends of all partitions in order: the row of each partition's last document."""
    first = held = None
    for b in batches:
        rows = []
        for i, side, t in zip(b.column("doc_id").to_pylist(), b.column("side").to_pylist(), b.column("text"), strict=True):
            if side == TAIL:
                held = _Doc(i, t.as_py())
                continue
            doc = _Doc(i, t.as_py())
            first = first or doc
            if held is not None:
                rows.append((*held.against(doc), 0, WHOLE, None))
        if rows:
            yield _batch(rows)
    if held is not None:
        yield _batch([(*held.against(first), 0, WHOLE, None)])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document, of its edited text, and their likeness, and that of the next document.

    The next document is the one of next lower id; after the lowest comes the highest, and a single document is its
    own next. Equal ids follow each other by their texts, null ids come last, a null text is an empty one. Texts are
    shuffled once, by ranges of id; each range hands its two outer texts to one small task that joins the ranges.
    """
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text").desc()]
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    schema = f"{_OUT}, shard int, side int, text string"
    rows = written(ranged.mapInArrow(_inner, schema), "order")
    ends = rows.filter(f"side <> {WHOLE}").repartition(1).sortWithinPartitions("shard", "side").mapInArrow(_ends, schema)
    return rows.filter(f"side = {WHOLE}").union(ends).drop("shard", "side", "text")


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
