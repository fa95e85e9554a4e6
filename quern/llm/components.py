"""Distributed union-find over an edge table, and whole linking of buckets without emitting all their pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.ordermin import distinct, mix
from quern.session import discard, release, written


def _flat(parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, up) with every up a root. Parents are less than their nodes, so there are no cycles."""
    before = None
    while True:
        nxt = parents.select(F.col("node").alias("n2"), F.col("up").alias("u2"))
        jumped = written(parents.join(nxt, parents.up == nxt.n2, "left").select("node", F.coalesce("u2", "up").alias("up"), F.col("u2").isNotNull().alias("moved")), "jump")
        discard(before)
        if jumped.filter("moved").isEmpty():
            return jumped
        parents, before = jumped.select("node", "up"), jumped


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the least node that can be reached.

    Each round hooks every node that has a lesser neighbour to the least of them, flattens the hooks by pointer
    jumping, and replaces the edges by those between the roots; the number of rounds grows with the logarithm of the
    nodes. Loops, repeats and both directions of an edge are allowed; edges with a null are ignored. With `known`, a
    result of earlier edges, the new ones join its components, whose nodes are not looked at one by one.
    """
    if known is not None:
        a, b = (known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
        both = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(both)
        old = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node"), "node", "left_anti")
        new = ends.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        out = written(old.unionByName(new), "labels")
        discard(joined)
        return out
    e = edges.dropna(subset=["a", "b"]).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e = written(e.filter("hi <> lo").distinct(), "edges")
    first, labels = e, None
    while not e.isEmpty():
        old = e, labels
        roots = _flat(e.groupBy("hi").agg(F.min("lo").alias("lo")).select(F.col("hi").alias("node"), F.col("lo").alias("up")))
        if labels is None:
            nodes = first.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
            labels = written(nodes.join(roots, "node", "left").select("node", F.coalesce("up", "node").alias("component")), "labels")
        else:
            up = roots.select(F.col("node").alias("component"), "up")
            labels = written(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        high = roots.select(F.col("node").alias("hi"), F.col("up").alias("a"))
        low = roots.select(F.col("node").alias("lo"), F.col("up").alias("u"))
        moved = e.join(high, "hi").join(low, "lo", "left").select("a", F.coalesce("u", "lo").alias("b")).filter("a <> b")
        e = written(moved.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
        discard(roots, *old)
    return labels if labels is not None else first.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


#: Bits of a filter. Its size does not depend on the data: with more numbers it only lets more of the others pass.
FILTER_BITS = 1 << 26


def filter_places(numbers: np.ndarray, tables: int = 1, table: int = 0) -> np.ndarray:
    """The bit of each number in one of the tables that share FILTER_BITS bits."""
    h = mix(numbers.astype(np.int64).view(np.uint64)) >> np.uint64(26 * table)
    return (h & np.uint64(FILTER_BITS // tables - 1)).astype(np.int64)


#: Ranges that a filter's bits are put together in, and tasks that do so.
RANGES, JOINING = 64, 12


def number_filter(df: DataFrame, column: str, tables: int = 1) -> Broadcast:
    """A filter of FILTER_BITS bits (8 MiB) that lets all numbers of a column pass, and few others.

    Places of bits travel packed, four bytes each, a row for each range of bits; Spark puts each range together. So what
    comes to the driver and is sent out has a fixed bound. Two tables of half the bits, each with a hash of its own, let
    far fewer others pass, as long as there are few numbers for the bits (`filter_tables`).
    """
    width = FILTER_BITS // RANGES

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            x = distinct(np.concatenate(held))
            cut = np.searchsorted(x, np.arange(RANGES + 1) * width).tolist()
            pieces = [(k, (x[i:j] - k * width).astype("<i4").tobytes()) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([d for _, d in pieces], pa.binary())], names=["part", "data"])

        for b in batches:
            if b.num_rows:
                held += [filter_places(b.column(0).to_numpy(), tables, k) + k * (FILTER_BITS // tables) for k in range(tables)]
                size += b.num_rows * tables
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bits = None, np.zeros(width, bool)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["part", "data"])

        for b in batches:
            for k, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                if part is not None and k != part:
                    yield out()
                    bits[:] = False
                part = k
                bits[np.frombuffer(data, "<i4")] = True
        if part is not None:
            yield out()

    placed = df.select(F.col(column).cast("long")).dropna().mapInArrow(packed, "part int, data binary").repartition("part").sortWithinPartitions("part").coalesce(JOINING)
    table = np.zeros((RANGES, width // 64), np.int64)
    found = placed.mapInArrow(joined, "part int, data binary").toArrow()
    for k, data in zip(found.column("part").to_pylist(), found.column("data").to_pylist(), strict=True):
        table[k] = np.frombuffer(data, "<i8")
    return df.sparkSession.sparkContext.broadcast(table.reshape(tables, -1))


def filter_tables(n: int) -> int:
    """How many tables let the fewest others pass in a filter of `n` numbers."""
    return 2 if n < 0.48 * FILTER_BITS else 1


def may_hold(tables: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Whether the filter lets each number pass."""
    at = filter_places(numbers, len(tables))
    out = (tables[0][at >> 6] >> (at & 63)) & 1 == 1
    for k in range(1, len(tables)):
        some = np.flatnonzero(out)
        at = filter_places(numbers[some], len(tables), k)
        out[some] = (tables[k][at >> 6] >> (at & 63)) & 1 == 1
    return out


#: Numbers that a task holds before it hands them out.
HELD = 1_000_000
#: Times this, keys of any form are spread over 48 bits evenly; it can be undone.
SPREAD = np.uint64(0x9E3779B97F4B)
MASK = np.uint64((1 << 48) - 1)


def _twice_at_most(x: np.ndarray) -> np.ndarray:
    """The numbers of an array, sorted, with two of those that repeat."""
    x = np.sort(x)
    return x if len(x) < 3 else x[np.concatenate([[True, True], x[2:] != x[:-2]])]


def shared_keys(rows: DataFrame, keyed: Callable, parts: int) -> DataFrame:
    """(key): the keys, 48 bits each, that more than one id has. `keyed` makes batches (key, id) of those of `rows`, each
    key of an id once.

    Nearly all keys have one row, so they travel packed: a row for each of `parts` ranges of keys holds many, six bytes
    each. A task sends a key twice at most, so a hot key does not weigh more than others.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            x = _twice_at_most(np.concatenate(held))
            at = np.searchsorted(x, np.array([(k << 48) // parts for k in range(parts + 1)][1:-1], np.uint64))
            cut = [0, *at.tolist(), len(x)]
            data = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            pieces = [(k, data[i:j].tobytes()) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([d for _, d in pieces], pa.binary())], names=["part", "data"])

        for b in keyed(batches):
            if b.num_rows:
                held.append((b.column("key").to_numpy().astype(np.uint64) * SPREAD) & MASK)
                size += b.num_rows
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def out() -> pa.RecordBatch:
            data = np.zeros((sum(map(len, held)) // 6, 8), np.uint8)
            data[:, :6] = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 6)
            x = np.sort(data.reshape(-1).view("<u8"))
            keys = (distinct(x[1:][x[1:] == x[:-1]]) * np.uint64(pow(int(SPREAD), -1, 1 << 48))) & MASK
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64))], names=["key"])

        for b in batches:
            for k, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                if held and k != part:
                    yield out()
                    held = []
                part = k
                held.append(data)
        if held:
            yield out()

    placed = rows.mapInArrow(packed, "part int, data binary").repartition("part").sortWithinPartitions("part")
    return placed.mapInArrow(shared, "key long")


def bucket_members(rows: DataFrame, keyed: Callable[[Broadcast | None], Callable], n_keys: int) -> DataFrame:
    """The (key, id) of keys that more than one id has, with the least of their ids as `lead`.

    `keyed` gives a function from batches of `rows` to batches (key, id), of all keys or those that a filter lets pass,
    each key of an id once; there are about `n_keys`. The keys that are shared are found first, from packed numbers.
    The rows are then made again without the others, and only those are joined.
    """
    found = written(shared_keys(rows, keyed(None), max(64, n_keys // HELD)), "shared")
    some = written(rows.mapInArrow(keyed(number_filter(found, "key", filter_tables(found.count()))), "key long, id long"), "keyed")
    release(rows.sparkSession)
    counted = some.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last"))
    members = written(some.join(counted.filter("lead <> last").select("key", "lead"), "key"), "buckets")
    discard(found, some)
    return members


#: Keys of so many rows at most are compared pair by pair where they come together.
MEET = 256
#: The two lowest bits of each byte of a sketch of up to 128, by planes.
PLANES = ("p0", "p1", "p2", "p3")


def low_bits(sketch: np.ndarray) -> np.ndarray:
    """(n, 4) signed 64-bit numbers of the two lowest bits of each byte of (n, up to 128) sketches."""
    planes = np.zeros((2, len(sketch), 16), np.uint8)
    for bit in range(2):
        planes[bit, :, : -(-sketch.shape[1] // 8)] = np.packbits((sketch >> bit) & 1, axis=1)
    return np.concatenate(list(planes.view(np.int64)), axis=1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bytes sketches differ at least, by their low_bits as unsigned numbers."""
    x = a ^ b
    return np.bitwise_count(x[:, :2] | x[:, 2:]).sum(axis=1, dtype=np.int64)


def _sieved(key: np.ndarray, ids: np.ndarray, bits: np.ndarray, most: int) -> pa.RecordBatch:
    """Rows of whole keys, sorted by (key, id) -> rows of sieved_members."""
    n = len(key)
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(n), 0))
    place, size = np.arange(n) - begin, np.bincount(begin, minlength=n)[begin]
    near = (place > 0) & (apart(bits, bits[begin]) <= most)
    other = (place > 0) & (size > MEET)
    partners = np.where(size <= MEET, np.maximum(place - 1, 0), 0)
    upto = np.cumsum(partners)
    for t in range(0, int(upto[-1]), PAIRS):
        pair = np.arange(t, min(t + PAIRS, int(upto[-1])))
        p = np.searchsorted(upto, pair, side="right")
        q = begin[p] + 1 + pair - (upto[p] - partners[p])
        ok = apart(bits[p], bits[q]) <= most
        other[p[ok]] = other[q[ok]] = True
    return _members(key, ids, ids[begin], near, other)


def _members(key: np.ndarray, ids: np.ndarray, lead: np.ndarray, near: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(near | other)
    return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, ids, lead, near, other)], names=["key", "id", "lead", "near", "other"])


def sieved_members(rows: DataFrame, keyed: Callable[[Broadcast | None, bool], Callable], n_keys: int, most: int) -> DataFrame:
    """As bucket_members, without rows whose sketches cannot agree with others of their key: (key, id, lead, near, other).

    `keyed` gives a function of batches to (key, id), and if told so with the low_bits of the id's sketch. Sketches that
    differ in more than `most` bytes by those bits do so by all, so no pair is lost. `near`: the row may be close to the
    lead; `other`: to a third row, or the key has more than MEET. Leads have no row. A key's rows come sorted, so a task
    holds a batch and MEET rows, however large the key is.
    """
    found = written(shared_keys(rows, keyed(None, False), max(64, n_keys // HELD)), "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for b in batches:
            if not b.num_rows:
                continue
            now = b.column("key").to_numpy(), b.column("id").to_numpy(), np.stack([b.column(c).to_numpy() for c in PLANES], axis=1).view(np.uint64)
            if large is not None:  # the key of the rows before goes on
                n = int(np.searchsorted(now[0], large[0], side="right"))
                yield _members(now[0][:n], now[1][:n], np.full(n, large[1]), apart(now[2][:n], large[2]) <= most, np.ones(n, bool))
                now = tuple(x[n:] for x in now)
                if not len(now[0]):
                    continue
                large = None
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                yield _sieved(*(x[:cut] for x in now), most)
            held = tuple(x[cut:] for x in now)
            if len(held[0]) > MEET:
                large = held[0][0], held[1][0], held[2][:1]
                n = len(held[0]) - 1
                yield _members(held[0][1:], held[1][1:], np.full(n, large[1]), apart(held[2][1:], large[2]) <= most, np.ones(n, bool))
                held = None
        if held is not None:
            yield _sieved(*held, most)

    wide = rows.mapInArrow(keyed(number_filter(found, "key", filter_tables(found.count())), True), "key long, id long, " + ", ".join(f"{c} long" for c in PLANES))
    placed = wide.repartition("key").sortWithinPartitions("key", "id")
    members = written(placed.mapInArrow(run, "key long, id long, lead long, near boolean, other boolean"), "buckets")
    discard(found)
    return members


#: Rows of a key that one block holds; a key of more rows is compared block by block, in tasks of their own.
BLOCK = 20_000
#: A key of so many rows at most, and a block's bytes, is one unit: each row is there once.
FEW = 64
#: Bytes of text that a block holds on average.
BLOCK_BYTES = 16 << 20
#: Pairs compared at once.
PAIRS = 200_000
#: Bytes of sketches compared at once.
CELLS = 8 << 20


def _near(rows: dict, p: np.ndarray, q: np.ndarray, least: int, percent: int, first_key: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places in `rows` those of different components that may be similar enough, by sizes and sketches."""

    def keep(ok: np.ndarray) -> None:
        nonlocal p, q
        p, q = p[ok], q[ok]

    keep(rows["c"][p] != rows["c"][q])
    if "n" in rows:
        n, m = rows["n"][p], rows["n"][q]
        keep(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    step = max(1, CELLS // (rows["sketch"].itemsize * rows["sketch"].shape[1]))  # wide sketches of all pairs would take a third of a GB
    parts = [agreement(rows["sketch"][p[t : t + step]], rows["sketch"][q[t : t + step]]) >= least for t in range(0, len(p), step)]
    keep(np.concatenate(parts) if parts else np.zeros(0, bool))
    if first_key is not None and len(p):
        sig = rows.get("sig", rows["sketch"])
        keep(first_key(sig[p], sig[q], rows["key"][p]))
    return p, q


class Forest:
    """Labels 0, 1, ..., n - 1 and which of them have been linked: a label's parent is the least one of its component."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def _one_each(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of the first of each pair of two numbers, whatever their order."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((high, low))
    first = np.ones(len(order), bool)
    first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    return order[first]


def _close(rows: dict, least: int, percent: int, first_key: Callable | None, exact: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the close pairs of many units (key, lo, hi), whose rows are sorted by (key, lo, hi, own).

    In a unit of one block each row meets those before it, in one of two blocks each row of the second meets all of
    the first. Pairs are laid out for many small units, or for a part of a large one, at a time.
    """
    n = len(rows["id"])
    new = np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1])])
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    firsts = np.bincount(begin, weights=rows["own"] == rows["lo"], minlength=n).astype(np.int64)[begin]
    partners = np.where(rows["lo"] == rows["hi"], np.arange(n) - begin, np.where(rows["own"] == rows["hi"], firsts, 0))
    upto = np.cumsum(partners)
    forest, label = Forest(0), rows["c"]
    if exact is not None:
        names, label = np.unique(rows["c"], return_inverse=True)
        forest = Forest(len(names))
    for t in range(0, int(upto[-1]) if n else 0, PAIRS):
        # Pairs t to t + PAIRS in the order of rows: whole rows, and parts of the first and the last.
        pair = np.arange(t, min(t + PAIRS, int(upto[-1])))
        p = np.searchsorted(upto, pair, side="right")
        q = begin[p] + pair - (upto[p] - partners[p])
        p, q = _near(rows, p, q, least, percent, first_key)
        if exact is not None and len(p):
            apart = forest.parent[label[p]] != forest.parent[label[q]]  # not joined by pairs before
            p, q = exact(rows, p[apart], q[apart])
            some = _one_each(label[p], label[q])
            p, q = p[some], q[some]
            forest.link(label[p], label[q])
        yield p, q


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bytes the rows of two arrays of 64-bit numbers are equal."""
    return (np.ascontiguousarray(a).view(np.uint8) == np.ascontiguousarray(b).view(np.uint8)).sum(axis=1)


UNIT = ("key", "lo", "hi", "own", "id", "c")
_UNIT = "key long, lo int, hi int, own int, id long, c long"


def units(rest: DataFrame, traits: DataFrame) -> DataFrame:
    """Rows of `rest` (key, id, c) with their `traits` (id, ...), for each pair of blocks (lo, hi) that they meet in.

    The rows of a key are split into blocks by a hash of the id, those of its largest component and the others apart, and
    each pair of blocks is a unit of work, so neither memory nor time of a task grows with the key. A block has a bounded
    number of rows, and of `bytes` if the traits have them. Two blocks of the largest component have nothing to compare,
    so a key whose ids are nearly all linked already takes work in proportion to its rows. A key of few rows is one unit.
    """
    rows = rest.join(traits.select("id", "bytes"), "id") if "bytes" in traits.columns else rest.withColumn("bytes", F.lit(0))
    kinds = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    kinds = kinds.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.sum("bytes").alias("total")).filter("all > most")
    blocks = lambda n: F.ceil(F.greatest(n / BLOCK, F.col("total") / BLOCK_BYTES, F.lit(1))).cast("int")
    few = (F.col("all") <= min(FEW, BLOCK)) & (F.col("total") <= BLOCK_BYTES)
    kinds = kinds.select("key", "main", blocks(F.col("most")).alias("m"), blocks(F.col("all") - F.col("most")).alias("g"), few.alias("few"))
    rows = rows.join(kinds, "key").withColumn("spread", F.xxhash64("id"))
    rows = rows.withColumn("own", F.when(F.col("few"), 0).when(F.col("c") == F.col("main"), F.pmod("spread", "m")).otherwise(F.col("m") + F.pmod("spread", "g")).cast("int"))
    first = F.when(F.col("own") < F.col("m"), F.col("m")).otherwise(0)
    rows = rows.withColumn("other", F.explode(F.when(F.col("few"), F.array(F.lit(0))).otherwise(F.sequence(first, F.col("m") + F.col("g") - 1))))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select(*UNIT)
    return rows.join(traits.drop("bytes"), "id")  # last, so that wide traits are dealt to their units only


def compare_units(rows: DataFrame, percent: int, least: int, first_key: Callable | None, exact: Callable | None, rows_out: bool) -> DataFrame:
    """Close pairs within units: of different c, of sizes n that allow `percent`, of sketches that agree in `least` bytes,
    and in the unit of the key that `first_key` picks, if given (of several keys that a pair shares one).

    With `rows_out`, the rows that have a close pair (UNIT columns, and sketches if `first_key` is told these); else (a, b). With `exact`, which picks the pairs that
    are linked, one pair is given for each two components that are compared together: more would tell nothing new.
    """
    kinds, lists = dict(rows.dtypes), [c for c in ("sketch", "sig") if c in rows.columns]
    with_sketch = rows_out and first_key is not None

    def arrays(b: pa.RecordBatch) -> dict:
        out = {k: b.column(k).to_numpy() for k in (*UNIT, *(["n"] if "n" in kinds else []))}
        if "text" in kinds:
            out["text"] = np.array(b.column("text").to_pylist(), object)
        if "set" in kinds:
            column = b.column("set")
            out["set"] = np.empty(b.num_rows, object)
            out["set"][:] = np.split(column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())[:-1])
        for k in lists:
            # Binary values or lists of longs, all of one length.
            kept = b.column(k)
            flat = np.frombuffer(b"".join(kept.to_pylist()), np.uint8) if pa.types.is_binary(kept.type) else kept.flatten().to_numpy().view(np.uint64)
            out[k] = flat.reshape(b.num_rows, -1)
        return out

    def compared(held: list[dict]) -> Iterator[pa.RecordBatch]:
        group = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        some = np.zeros(len(group["id"]), bool)
        for p, q in _close(group, least, percent, first_key, exact):
            if rows_out:
                some[p] = some[q] = True
            elif len(p):
                a, b = group["id"][p], group["id"][q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        if some.any():
            cols = [pa.array(group[k][some]) for k in UNIT]
            if with_sketch:
                cols.append(pa.array([x.tobytes() for x in group["sketch"][some]], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=[*UNIT, "sketch"][: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = arrays(b)
            # Units that end in this batch are compared; the last one may go on in the next.
            place = [cols[k] for k in ("key", "lo", "hi")]
            last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in place]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and held and any(h[k][-1] != x[0] for h in held[-1:] for k, x in zip(("key", "lo", "hi"), place, strict=True)):
                yield from compared(held)
                held = []
            if cut:
                yield from compared([*held, {k: v[:cut] for k, v in cols.items()}])
                held = []
            held.append({k: v[cut:] for k, v in cols.items()})
        if held:
            yield from compared(held)

    placed = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own", "id")
    return placed.mapInArrow(run, _UNIT + ", sketch binary" * with_sketch if rows_out else "a long, b long")


def linked_pairs(rest: DataFrame, traits: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame], percent: int, least: int, first_key: Callable, exact: Callable) -> DataFrame:
    """(a, b): links that join the components of `rest` (key, id, c), as many as it takes.

    First by `traits` (id, n, sketch, bytes): rows that have no close pair in their unit go. Then the others' `texts` (id,
    n, sketch, sig, and text or set) meet in the same units. What is given out grows with rows, not with pairs. `texts`
    may be a function of the rows (id) whose texts are wanted, to (id, n, text); then `first_key` is told sketches, so
    that it picks the unit of a pair from the start.
    """
    near = written(compare_units(units(rest, traits), percent, least, first_key if callable(texts) else None, None, True), "near")
    release(rest.sparkSession)
    whole = texts(near.select("id")) if callable(texts) else texts
    return compare_units(near.join(whole, "id"), percent, least, first_key, exact, False).distinct()


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], rest_of: Callable[[DataFrame], DataFrame], sift: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the ids that `verify` links, as if all pairs of ids with a common key had been verified.

    `verify` takes pairs (a, b) and returns those that are linked. A pair within a component tells nothing new, so:
    first each id meets the least of its leads, then its other leads. Then, in keys that still hold several components,
    ids of different components meet: `rest_of` gives links of rows (key, id, c) that join them. Leads have met all ids of
    their keys by then and stay away. Members may be sieved: then only their near pairs and other rows meet. A large group of alike ids takes a pair for each id in the first two rounds, and
    none in the third. `sift`, if given, leaves out pairs (lead, id) that cannot be linked before all that; what it
    returns is written.
    """
    sieved = "near" in members.columns
    stars = members.filter("near" if sieved else "id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    spark = members.sparkSession
    if sift is not None:
        stars = sift(stars.distinct())
    tried = written(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    comp = components(written(verify(tried), "linked"))
    release(spark)

    a, b = (comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    new = stars.distinct().join(tried, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left")
    second = written(new.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "tried")
    if not second.isEmpty():
        comp = components(written(verify(second), "linked"), comp)
        release(spark)
    others = members.filter("other" if sieved else "id <> lead")
    now = others.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key")
    rest = written(now.join(mixed, "key"), "mixed")
    if not rest.isEmpty():
        comp = components(written(rest_of(rest), "linked"), comp)
        release(spark)
    discard(rest)
    return comp
