"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has 66 MinHash values of 8 bits. It is split into 11 chunks of 6 values. By the pigeonhole principle two
signatures that differ in at most 21 values differ in at most one value of some chunk, and then agree in that chunk
with one value left out. So each signature is listed under its 66 chunks with one value left out, and every pair
within distance 21 shares a key. At a similarity of 0.85 the distance is 9.8 on average; beyond 21 lie 1.5 pairs in ten
thousand. For similarities from 0.8 on there is a layout of 75 values in 15 chunks of 5, whose keys hold all pairs
within distance 29: on average the distance is 14.9 at 0.8, and beyond 29 lie 0.5 pairs in ten thousand. Documents that share keys get a second, finer signature, by which pairs that cannot be similar
enough are put aside; the rest is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import bucket_members, link_buckets, linked_pairs, may_hold
from quern.llm.pretok import lean, slices
from quern.llm.shingles import minhash, set_digest, shingle_sets, sketch, sketch_least
from quern.session import written

ERRORS = 1


class Layout(NamedTuple):
    chunks: int
    values: int  # of a chunk

    @property
    def positions(self) -> int:
        return self.chunks * self.values

    @property
    def distance(self) -> int:
        """The largest distance of which all pairs are found."""
        return self.chunks * (ERRORS + 1) - 1

    @property
    def longs(self) -> int:
        return -(-self.positions // 8)


#: The least percentage that a layout serves, and the layout.
LAYOUTS = ((85, Layout(11, 6)), (80, Layout(15, 5)))


def layout_for(percent: int) -> Layout:
    for least, layout in LAYOUTS:
        if percent >= least:
            return layout
    raise ValueError(f"the signatures are laid out for {LAYOUTS[-1][0]} percent and more")


def signature(shingles: np.ndarray, layout: Layout) -> list[int]:
    """8 bits of each MinHash value, packed into signed 64-bit integers."""
    low = np.zeros(8 * layout.longs, np.uint8)
    low[: layout.positions] = minhash(shingles, layout.positions).astype(np.uint8)
    return low.view("<i8").tolist()


def chunk_keys(signatures: np.ndarray, layout: Layout) -> np.ndarray:
    """(n, longs) signatures -> (n, positions) keys: each chunk without one of its values, marked with both places."""
    values = np.ascontiguousarray(signatures).view(np.uint8).reshape(len(signatures), -1)[:, : layout.positions].astype(np.int64)
    chunks = values.reshape(-1, layout.chunks, layout.values)
    out = np.empty_like(chunks)
    for left_out in range(layout.values):
        key = np.arange(layout.chunks, dtype=np.int64) * layout.values + left_out
        key = np.broadcast_to(key, chunks.shape[:2])
        for v in range(layout.values):
            if v != left_out:
                key = (key << 8) | chunks[:, :, v]
        out[:, :, left_out] = key
    return out.reshape(len(signatures), -1)


def first_shared_key(a: np.ndarray, b: np.ndarray, key: np.ndarray, layout: Layout) -> np.ndarray:
    """For pairs of packed signatures within the distance: whether `key` is the first of the keys that the pair shares."""
    split = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, : layout.positions]
    chunks = (split(a) != split(b)).reshape(-1, layout.chunks, layout.values).sum(axis=2)
    chunk, left_out = np.divmod(key >> (8 * (layout.values - 1)), layout.values)
    first = (chunks <= ERRORS).argmax(axis=1) == chunk
    return first & ((chunks[np.arange(len(key)), chunk] == ERRORS) | (left_out == 0)) & (chunks.sum(axis=1) <= layout.distance)


def distance(a: str, b: str, layout: Layout):
    """Column: in how many values two packed signatures differ."""
    total = F.lit(0)
    for k in range(layout.longs):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for s in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _signed(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, signed = [], [], []
            for part in slices([t or "" for t in b.column("text").to_pylist()]):
                for s in shingle_sets(part):
                    n.append(len(s))
                    digests.append(set_digest(s) if len(s) else None)
                    signed.append(signature(s, layout) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(signed, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig"])

    return run


def _keyed(layout: Layout, only: Broadcast | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                keys = chunk_keys(part.column("sig").flatten().to_numpy().reshape(-1, layout.longs), layout).reshape(-1)
                ids = np.repeat(part.column("id").to_numpy(), layout.positions)
                if only is not None:
                    keep = may_hold(only.value, keys)
                    keys, ids = keys[keep], ids[keep]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "id"])

    return run


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for part in slices([t or "" for t in b.column("text").to_pylist()]):
            sets = shingle_sets(part)
            arrays = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(part)), b.column("digest").slice(at, len(part)), pa.array([set_digest(s) for s in sets]), arrays, pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["id", "digest", "own", "shingles", "sketch"])
            at += len(part)


def near_duplicates(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, n_shingles, component_id, kept.

    Shingles are 5 words, A-Z lower-cased; documents are linked at 100 * intersection >= percent * union.
    component_id is the least doc_id that links reach. Equal shingle sets are one class and are linked without
    comparison. Null, empty and blank texts have no shingles and only themselves as component. A row without a doc_id
    links nothing: its component_id is null and it is kept. Rows of one doc_id and different texts belong each to the
    component of their text. percent below 80 would need a wider signature and is refused.
    """
    layout = layout_for(percent)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(docs.mapInArrow(lean(_signed(layout)), "doc_id long, n_shingles long, digest string, sig array<long>"), "signed")
    known = signed.filter("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    # The ids are written, so that they are the same wherever the table is read.
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = bucket_members(classes.select("id", "sig"), partial(_keyed, layout), classes.count() * layout.positions)

    wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "digest", "doc_id")
    texts = docs.join(wanted, "doc_id").select("id", "digest", "text").mapInArrow(lean(_sets), "id long, digest string, own string, shingles array<long>, sketch array<long>")
    # A doc_id with several texts brings other sets too; a repeated row brings its set twice.
    sets = written(texts.filter("own = digest").dropDuplicates(["id"]).select("id", "shingles", "sketch"), "sets")
    short = classes.select("id", "n", "sig")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (short.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "sig"))) for x in "ab")
        near = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))
        near = near.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (distance("sig_a", "sig_b", layout) <= layout.distance)).select("a", "b")
        left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        both = near.join(right, "b").join(left, "a")
        common = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("i"), (F.size("s_a") + F.size("s_b")).alias("t"))
        return common.filter(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("t") - F.col("i"))).select("a", "b")

    def exact(rows: dict, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = np.array([in_common(x, y) for x, y in zip(rows["set"][p], rows["set"][q], strict=True)], np.int64)
        ok = 100 * common >= percent * (rows["n"][p] + rows["n"][q] - common)
        return p[ok], q[ok]

    def rest_of(rest: DataFrame) -> DataFrame:
        sketched = short.join(sets, "id")
        traits = sketched.select("id", "n", "sketch", (F.col("n") * 8).alias("bytes"))
        whole = sketched.select("id", "n", "sig", "sketch", F.col("shingles").alias("set"))
        return linked_pairs(rest, traits, whole, percent, sketch_least(percent), partial(first_shared_key, layout=layout), exact)

    linked = link_buckets(members, verify, rest_of)
    least = linked.join(classes.select(F.col("id").alias("node"), "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(least, "component").select(F.col("node").alias("id"), "component_id")
    groups = written(classes.join(named, "id", "left").select("digest", F.coalesce("component_id", "doc_id").alias("group_id")), "groups")
    out = signed.join(groups, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("group_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one document of each group: the one of least doc_id. Rows without a doc_id stay.

    Only the ids that go are joined to the texts. Repeated rows of a doc_id that stays all stay; a doc_id that has
    several texts goes if one of them goes.
    """
    groups = near_duplicates(df, percent, id_col, text_col)
    name = "_gone"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    gone = written(groups.filter("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return df.join(gone, df[id_col].cast("long") == F.col(name), "left_anti")


def op6_hamming_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all whole documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
