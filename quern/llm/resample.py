"""Importance resampling of documents towards a target distribution, by hashed word n-grams.

The CRC of a word is computed once. That of a run of words follows from the CRCs and lengths of its words: appending
n bytes to a string multiplies its CRC by a matrix over GF(2), and the CRC of what is appended is added. So no n-gram
is ever put together as a string. The matrices are kept for lengths that are powers of two, as tables of bytes.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.pretok import lean, slices
from quern.session import written

POLYNOMIAL = 0xEDB88320
#: Longer words get their CRC one by one; the others byte place by byte place, all at once.
LONG_WORD = 64
BUCKETS, GRAMS, SEED = 10_000, 2, 7
#: Bytes of words: digits, letters (A-Z are lower-cased), and all of other code points.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


_BYTE = _byte_table()
_SPACE = np.uint32(zlib.crc32(b" "))


def _tables(columns: np.ndarray) -> np.ndarray:
    """A matrix, as the images of the 32 bits, as four tables of the images of a byte."""
    out = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for bit in range(32):
        out[bit // 8] ^= np.where(values >> (bit % 8) & 1, columns[bit], 0).astype(np.uint32)
    return out


def _times(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for k in (1, 2, 3):
        out ^= table[k][(crc >> np.uint32(8 * k)) & 255]
    return out


@cache
def shift_table(power: int) -> np.ndarray:
    """The matrix of appending 2^power zero bytes: that of half as many, applied to itself."""
    bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    if power == 0:
        return _tables(_BYTE[bits & 255] ^ (bits >> np.uint32(8)))
    half = shift_table(power - 1)
    return _tables(_times(half, _times(half, bits)))


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC times the matrix of its own length: the bits of the lengths choose the matrices."""
    out = crc.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        some = np.flatnonzero(lengths >> power & 1)
        out[some] = _times(shift_table(power), out[some])
    return out


def combined(a: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """The CRCs of strings put together from two parts, from those of the parts and the length of the second."""
    return shifted(a, b_lengths) ^ b


def word_crcs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC of every word in order, its length in bytes, number of words of each text)."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw])
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    edges = np.diff(_WORD[data].view(np.int8), prepend=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # the last byte is no word's
    length = end - begin
    order = np.argsort(-length, kind="stable")
    crc, size = np.full(len(begin), 0xFFFFFFFF, np.uint32), length[order]
    at = begin[order]
    long = int(np.searchsorted(-size, -LONG_WORD))
    for place in range(int(size[long]) if long < len(size) else 0):
        upto = int(np.searchsorted(-size, -place))  # words of more bytes than `place`
        c = crc[long:upto]
        crc[long:upto] = _BYTE[(c ^ data[at[long:upto] + place]) & 255] ^ (c >> np.uint32(8))
    crc = ~crc
    for k in range(long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + size[k]])
    out = np.empty_like(crc)
    out[order] = crc
    return out, length, np.bincount(np.searchsorted(ends, begin, side="right"), minlength=len(raw))


def feature_crcs(texts: list[str], grams: int = GRAMS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text, and for runs of 1 to `grams` words their CRCs with the text of each."""
    crc, length, counts = word_crcs(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    run, out = crc, [(crc, owner)]
    for k in range(1, grams):
        n = max(0, len(crc) - k)
        spaced = combined(run[:n], np.broadcast_to(_SPACE, n), np.ones(n, np.int64))
        run = combined(spaced, crc[k:], length[k:])
        whole = owner[:n] == owner[k:]
        out.append((run[whole], owner[:n][whole]))
    return counts, out


def _counted(buckets: int, grams: int):
    """Features in each bucket: one row a task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices([t or "" for t in b.column(0).to_pylist()]):
                for crc, _ in feature_crcs(part, grams)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return lean(run)


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's smoothed shares in `target` and `docs`. There are `buckets` rows of
    counts, so they may come to the driver."""
    own, other = (x.select(text_col).mapInArrow(_counted(buckets, grams), "bucket int, n long") for x in (docs, target))
    both = own.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(other.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = found.column("bucket").to_numpy()
    s[at], t[at] = found.column("s").to_numpy(), found.column("t").to_numpy()
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    ratio = lambda k, m: ((m + 1) * all_s) / ((k + 1) * all_t)  # noqa: E731  exact integers, one rounding
    return np.array([math.floor(1000 * math.log(ratio(k, m))) for k, m in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def gumbel(key: str) -> int:
    """floor(1000 times) a Gumbel number that depends on the key alone."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gains: np.ndarray, grams: int, seed: int):
    buckets = np.uint32(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column(0).to_pylist(), 0
            for part in slices([t or "" for t in b.column(1).to_pylist()]):
                words, features = feature_crcs(part, grams)
                n, total = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for crc, owner in features:
                    n += np.bincount(owner, minlength=len(part))
                    upto = np.concatenate([[0], np.cumsum(gains[crc % buckets])])
                    ends = np.cumsum(np.bincount(owner, minlength=len(part)))
                    total += np.diff(upto[ends], prepend=0)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                noise = np.array([gumbel(f"{seed}:{'' if i is None else i}") for i in ids[at : at + len(part)]], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(words), pa.array(n), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "n_words", "n_features", "weight", "score"])
                at += len(part)

    return lean(run)


def ranked(rows: DataFrame, score: str, key: str, share: int) -> DataFrame:
    """`rows` with `rank` 1, 2, 3, ... of the floor(share * n / 100) highest scores, ties to the lesser key; null beyond.

    Rows are dealt by ranges of (score, key) and sorted there; a row's rank is its place plus the rows of the ranges
    before. Equal rows may be dealt to several ranges, so a repeated row is no hot key.
    """
    own = "_place"
    while own in {c.lower() for c in rows.columns}:
        own += "_"
    order = [F.desc(score), F.asc_nulls_first(key), F.asc(own)]
    dealt = rows.withColumn(own, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn(own, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(own, 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col(own).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    got = placed.join(F.broadcast(before), part == F.col("part"))
    return got.select(*rows.columns, F.when(rank * 100 <= F.col("all") * share - F.pmod(F.col("all") * share, F.lit(100)), rank).cast("long").alias("rank"))


def resample(df: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """One row for each row of `df`: doc_id, n_features, weight, score, rank.

    Words are runs of digits, letters and code points from U+0080 on, A-Z lower-cased; features are all runs of 1 to
    `grams` words. weight is the floored mean of the gains of the features' buckets, 0 without features; score adds
    Gumbel noise of (seed, id), so that the highest scores are a sample without replacement. Of the rows with
    `least_words` words, `share` percent are drawn and ranked.

    Null and empty texts have no words, weight 0 and no rank. Rows without an id all have the noise of an empty id and
    come before others of the same score. Repeated rows are ranked one by one. Without a target text, or without
    documents, shares are those of smoothing alone. A text is worked on as a whole: it takes about 30 times its
    bytes of memory for a moment. Other columns of `df` are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gains = bucket_gains(docs, target.select(F.col(text_col).alias("text")), "text", buckets, grams)
    scored = written(docs.mapInArrow(_scored(gains, grams, seed), "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    names = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(scored.filter(F.col("n_words") >= least_words).select(*names), "score", "doc_id", share)
    return drawn.unionByName(scored.filter(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All whole documents, drawn towards the texts of `benchmark`."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)
