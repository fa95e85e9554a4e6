"""Near-duplicates of embeddings by products of int8 tiles with rigorous error bounds.

A vector u of length 1 is kept as s * q with q of int8, and r = |u - s q|. For two vectors
|u.v - s_u s_v (q_u.q_v)| <= r_u + r_v (1 + r_u), so the integer product of two tiles tells of nearly every pair on which
side of the threshold it is. Only pairs between the bounds are computed again, from the vectors themselves in double
precision. A tile is a bounded number of vectors; int8 is what is sent to each tile's partners. No pair is ever given out:
a task returns how many links each vector has and a spanning forest of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quern.llm.components import Forest, components
from quern.session import discard, written

#: Most vectors of a tile, and most bytes of its int8 values.
TILE, TILE_BYTES = 65_536, 16 << 20
#: Tiles are not made smaller than this to have more of them.
LEAST_TILE = 1_024
#: Products of a strip of a tile that are held at once.
CELLS = 1_000_000
#: So many products of two int8 add up exactly in 32-bit floating point.
EXACT = (1 << 24) // (127 * 127)
#: More than the rounding of sums and bounds in double precision.
SLOP = 1e-9
#: A class of more than a thousandth of all rows is hot; there are at most so many.
HOT = 1_000


def _keys(is_float: bool) -> Callable:
    """(vec_id, dims, digest, raw): the bytes of vectors that can be compared; null for the others."""
    kind = np.float32 if is_float else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten()  # without what null lists span
            values = flat.to_numpy(zero_copy_only=False).astype(kind)  # nulls become NaN
            sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            begin = np.cumsum(sizes) - sizes
            fit = np.isfinite(values)
            some = values != 0
            upto, nonzero = (np.concatenate([[0], np.cumsum(x)]) for x in (fit, some))
            good = (upto[begin + sizes] - upto[begin] == sizes) & (nonzero[begin + sizes] > nonzero[begin])
            values = values + kind(0)  # -0 is 0
            raw = [values[i : i + n].tobytes() if ok else None for i, n, ok in zip(begin.tolist(), sizes.tolist(), good.tolist(), strict=True)]
            digests = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "dims", "digest", "raw"])

    return run


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors as rows of length 1, in double precision; first over their largest value, lest squares overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, length of what is left) of rows of length 1."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - scale[:, None] * q) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15


def _quantised(is_float: bool) -> Callable:
    kind = np.float32 if is_float else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw").to_pylist()
            q, scale, left = [b""] * len(raw), np.empty(len(raw)), np.empty(len(raw))
            for begin in range(0, len(raw), 1000):
                part = range(begin, min(begin + 1000, len(raw)))
                for n in {len(raw[k]) for k in part}:
                    at = [k for k in part if len(raw[k]) == n]
                    found, scale[at], left[at] = quantised(unit(np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), -1)))
                    for k, row in zip(at, found, strict=True):
                        q[k] = row.tobytes()
            cols = {"q": pa.array(q, pa.binary()), "scale": pa.array(scale), "left": pa.array(left)}
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names), *cols.values()], names=[*b.schema.names, *cols])

    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, by 32-bit floating point over as many dimensions as are exact in it."""
    if a.shape[1] <= EXACT:
        return a @ b.T
    return sum((a[:, k : k + EXACT] @ b[:, k : k + EXACT].T).astype(np.float64) for k in range(0, a.shape[1], EXACT))


def tile_links(rows: dict, split: int, threshold: float, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a pair of tiles, the first `split` rows and the others (or of one tile, if `split` is 0): the links of each
    row, the labels, each label's parent, and which rows have a partner between the bounds.

    `rows`: q, scale, left, weight, c (labels). With `full`, rows have `u` too: only the pairs between the bounds are
    looked at, and computed in double precision.
    """
    q, scale, left, weight = (rows[k] for k in ("q", "scale", "left", "weight"))
    n, one = len(q), split == 0
    labels, at = np.unique(rows["c"], return_inverse=True)
    forest, links, unsure = Forest(len(labels)), np.zeros(n), np.zeros(n, bool)
    q = q.astype(np.float32)
    strip = max(1, CELLS // max(1, n - split))
    for begin in range(0, n if one else split, strip):
        end = min(begin + strip, n if one else split)
        other = begin if one else split
        if other == n:
            break
        product = _product(q[begin:end], q[other:])
        need = threshold - SLOP - left[begin:end] - left[other:].max() * (1 + left[begin:end])
        least = np.where(need > 0, need / (scale[begin:end] * scale[other:].max()) * (1 - 1e-6), -np.inf)
        p, o = np.divmod(np.flatnonzero(product >= least[:, None]), n - other)
        near = product[p, o].astype(np.float64)
        p, o = p + begin, o + other
        if one:
            keep = p < o
            p, o, near = p[keep], o[keep], near[keep]
        near *= scale[p] * scale[o]
        bound = left[p] + left[o] * (1 + left[p]) + SLOP
        sure = near - bound >= threshold
        maybe = ~sure & (near + bound >= threshold)
        if full:
            p, o = p[maybe], o[maybe]
            step = max(1, CELLS // q.shape[1])
            ok = [np.einsum("ij,ij->i", rows["u"][p[k : k + step]], rows["u"][o[k : k + step]]) >= threshold for k in range(0, len(p), step)]
            hit = np.concatenate([*ok, np.empty(0, bool)])
        else:
            unsure[p[maybe]] = True
            unsure[o[maybe]] = True
            hit = sure
        p, o = p[hit], o[hit]
        links += np.bincount(p, weights=weight[o], minlength=n) + np.bincount(o, weights=weight[p], minlength=n)
        forest.link(at[p], at[o])
    return links, labels, forest.parent, unsure


def _tiled(work: Callable[[dict, tuple], Iterator[pa.RecordBatch]], columns: list[str]) -> Callable:
    """A mapInArrow function that calls `work` with all rows of each (dims, i, j), which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            place = np.stack([b.column(k).to_numpy() for k in ("dims", "i", "j")])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if begin == end:
                    continue
                now = tuple(place[:, begin].tolist())
                if held and now != key:
                    yield from work(_arrays(held, key, columns), key)
                    held = []
                key = now
                held.append(b.slice(begin, end - begin))
        if held:
            yield from work(_arrays(held, key, columns), key)

    return run


def _arrays(held: list[pa.RecordBatch], key: tuple, columns: list[str]) -> dict:
    whole = pa.Table.from_batches(held)
    out = {k: whole.column(k).to_numpy() for k in columns}
    out["q"] = np.frombuffer(b"".join(whole.column("q").to_pylist()), np.int8).reshape(whole.num_rows, key[0])
    if "raw" in whole.column_names:
        raw = whole.column("raw").to_pylist()
        kind = np.float32 if len(raw[0]) == 4 * key[0] else np.float64
        out["u"] = unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))
    return out


_NUMBERS = ["id", "own", "c", "scale", "left", "weight"]
FOUND = "kind int, dims int, i int, j int, id long, n long"
LINKS, EDGE, UNSURE = 0, 1, 2


def _found(key: tuple, ids: np.ndarray, links: np.ndarray, labels: np.ndarray, parent: np.ndarray, unsure: np.ndarray) -> pa.RecordBatch:
    """What a pair of tiles gives: numbers of links by id, edges between labels, and ids with a partner to compute."""
    some, child = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(parent)))
    kinds = np.repeat(np.array([LINKS, EDGE, UNSURE], np.int32), [len(some), len(child), int(unsure.sum())])
    a = np.concatenate([ids[some], labels[child], ids[unsure]]).astype(np.int64)
    b = np.concatenate([links[some].astype(np.int64), labels[parent[child]], np.zeros(int(unsure.sum()), np.int64)])
    dims, i, j = (pa.array(np.full(len(kinds), k, np.int32)) for k in key)
    return pa.RecordBatch.from_arrays([pa.array(kinds), dims, i, j, pa.array(a), pa.array(b)], names=["kind", "dims", "i", "j", "id", "n"])


def _pairs(threshold: float, full: bool) -> Callable:
    def work(rows: dict, key: tuple) -> Iterator[pa.RecordBatch]:
        split = 0 if key[1] == key[2] else int((rows["own"] == key[1]).sum())
        if key[1] == key[2] or 0 < split < len(rows["id"]):
            yield _found(key, rows["id"], *tile_links(rows, split, threshold, full))

    return _tiled(work, _NUMBERS)


def _within(threshold: float) -> Callable:
    """The rows of each tile with labels of its own components, their links there, and whether some are unsure."""

    def work(rows: dict, key: tuple) -> Iterator[pa.RecordBatch]:
        links, labels, parent, unsure = tile_links(rows, 0, threshold, False)
        c = labels[parent[np.searchsorted(labels, rows["c"])]]
        q = pa.array([x.tobytes() for x in rows["q"]], pa.binary())
        cols = {"dims": pa.array(np.full(len(c), key[0], np.int32)), "own": pa.array(rows["own"]), "id": pa.array(rows["id"]), "c": pa.array(c), "q": q}
        cols |= {k: pa.array(rows[k]) for k in ("scale", "left", "weight")} | {"n": pa.array(links.astype(np.int64)), "unsure": pa.array(unsure)}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return _tiled(work, _NUMBERS)


def embedding_duplicates(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of `df`: vec_id, n_links, component_id, kept. Links are pairs of cosine >= threshold.

    All pairs of vectors of the same number of dimensions are covered. Equal vectors are one class: they are linked,
    and compared once. n_links counts rows, so a repeated row is a link more. Vectors that are null, empty, zero, or
    hold a null or a number that is not finite have no links and only themselves as component; so have rows without an
    id, whose component_id is null and which are kept. Other columns are not read. The threshold must be above 0.

    Work grows with the square of the distinct vectors, divided among as many tasks as there are pairs of tiles; each
    vector's int8 values are sent to every tile.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark, kind = df.sparkSession, df.schema[vector_col].dataType
    is_float = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if is_float else "array<double>").alias("v"))
    keyed = written(vectors.mapInArrow(_keys(is_float), "vec_id long, dims int, digest binary, raw binary"), "vectors")
    known = keyed.filter("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.min("dims").alias("dims"), F.min("raw").alias("raw"), F.count("*").alias("weight"))
    classes = classes.withColumn("id", F.monotonically_increasing_id())
    schema = "digest binary, vec_id long, dims int, raw binary, weight long, id long, q binary, scale double, left double"
    classes = written(classes.mapInArrow(_quantised(is_float), schema), "classes")

    tasks = math.isqrt(8 * spark.sparkContext.defaultParallelism) + 1
    tile = F.least(F.lit(TILE), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / F.col("dims"))))
    blocks = F.greatest(F.ceil(F.col("n") / tile), F.least(F.lit(tasks), F.ceil(F.col("n") / LEAST_TILE)))
    sizes = classes.groupBy("dims").agg(F.count("*").alias("n")).select("dims", blocks.cast("int").alias("blocks"))
    rows = classes.join(sizes, "dims").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.select("dims", "own", "id", F.col("id").alias("c"), "q", "scale", "left", "weight", F.col("own").alias("i"), F.col("own").alias("j"))
    placed = ["dims", "i", "j"]
    dealt = lambda x: x.repartition(*placed).sortWithinPartitions(*placed, "own", "id")
    tiles = written(dealt(rows).mapInArrow(_within(threshold), "dims int, own int, id long, c long, q binary, scale double, left double, weight long, n long, unsure boolean"), "tiles")

    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own")))
    sent = tiles.drop("n", "unsure").join(sizes, "dims").withColumn("other", others)
    sent = sent.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    crossed = written(dealt(sent).mapInArrow(_pairs(threshold, False), FOUND), "crossed")

    # Vectors with a partner between the bounds go to that pair of tiles once more, in full.
    unsure = crossed.filter(F.col("kind") == UNSURE).select("dims", "i", "j", "id")
    unsure = unsure.union(tiles.filter("unsure").select("dims", F.col("own").alias("i"), F.col("own").alias("j"), "id"))
    again = unsure.join(tiles.drop("dims", "n", "unsure"), "id").join(classes.select("id", "raw"), "id")
    exact = written(dealt(again).mapInArrow(_pairs(threshold, True), FOUND), "exact")

    found = crossed.union(exact)
    links = found.filter(F.col("kind") == LINKS).select("id", "n").union(tiles.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.filter(F.col("kind") == EDGE).select(F.col("id").alias("a"), F.col("n").alias("b")))
    c = tiles.select("id", "c").join(joined.select(F.col("node").alias("c"), "component"), "c", "left").select("id", F.coalesce("component", "c").alias("component"))
    named = written(classes.select("digest", "id", "vec_id", "weight").join(c, "id").join(links, "id"), "named")
    discard(tiles, crossed, exact, classes)

    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    named = written(_given(named, least, "component", named.count()).select("digest", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id", "weight"), "groups")
    out = _given(keyed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")), named.withColumnRenamed("weight", "n"), "digest", keyed.count())
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _given(rows: DataFrame, named: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` with what `named` (key, n, ...) has for their key, if any; n is how many rows have it, out of `total`.

    Keys of more than a thousandth of all rows are fewer than a thousand: those are broadcast, the others joined.
    """
    hot = named.filter(F.col("n") * HOT > total)
    cold = named.join(F.broadcast(hot.select(key)), key, "left_anti").drop("n")
    taken = rows.join(F.broadcast(hot.drop("n")), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    none, some = rest.filter(F.col(key).isNull()), rest.filter(F.col(key).isNotNull())
    blank = [F.lit(None).cast(t).alias(c) for c, t in named.drop("n").dtypes if c != key]
    return taken.unionByName(some.join(cold, key, "left")).unionByName(none.select("*", *blank))


def op13_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """Groups of all embeddings by links of cosine 0.9 and more, whatever their labels."""
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
