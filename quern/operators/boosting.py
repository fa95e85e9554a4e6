"""Histogram gradient boosting of many models at once, with trees that grow leaf by leaf.

Rows belong to models (here a cutoff each) and have binned features. A tree is grown best first: of all leaves the one
whose best split gains most is split next. What a split needs are sums of gradients, weights and rows by feature and bin;
only the smaller child is counted, the other is the difference to the parent.

A model whose rows are few is grown by one task, all its rounds. Models of more rows are grown by jobs for all of them
together: tasks add up histograms by (model, leaf), which are merged by (model, leaf) before the best split is taken, and
a leaf's value under absolute loss is a distributed weighted median. Both give the same trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import discard, written

#: Models of up to so many rows are a task's work.
IN_MEMORY = 500_000
#: Rows of a batch whose histograms are counted at once.
BATCH = 50_000
#: What a row of sums is to its node.
PARENT, PLUS, MINUS = 0, 1, 2


@dataclass(frozen=True)
class Boosting:
    """Parameters. Categories are ordered by gradient over weight, both smoothed, and split like numbers."""

    rounds: int = 650
    leaves: int = 127
    step: float = 0.045
    loss: str = "absolute"  # or "squared"
    l2: float = 1.0
    least_rows: int = 20
    least_weight: float = 1e-3
    row_share: float = 0.8
    column_share: float = 0.9
    smooth: float = 10.0
    category_l2: float = 10.0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.loss not in ("absolute", "squared"):
            raise ValueError(f"unknown loss {self.loss}")


@dataclass(frozen=True)
class Layout:
    """Features by place: edges of numbers (values up to edge k are bin k + 1), values of categories; bin 0 is missing."""

    numbers: tuple[tuple[str, tuple[float, ...]], ...]
    categories: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in (*self.categories, *self.numbers)]

    @property
    def width(self) -> int:
        return max([len(v) + 2 for _, v in self.numbers] + [len(v) + 1 for _, v in self.categories])


def layout(rows: DataFrame, numbers: tuple[str, ...], categories: tuple[str, ...], bins: int = 255, of_edges: DataFrame | None = None) -> Layout:
    """Quantiles of the numbers of `of_edges` (or all rows) and the categories of all rows: a bounded number of values."""
    share = [k / (bins - 1) for k in range(bins)]
    base = of_edges if of_edges is not None else rows
    found = base.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), share, 10_000).alias(c) for c in numbers)).first()
    edges = tuple((c, tuple(sorted(set(found[c] or [0.0]))[:-1])) for c in numbers)
    values = rows.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in categories)).first() if categories else {}
    return Layout(edges, tuple((c, tuple(values[c])) for c in categories))


def binned(rows: DataFrame, of: Layout, keep: tuple[str, ...]) -> DataFrame:
    """`keep` and `x`: the bins of a row, two bytes a feature. Nulls, NaN and unknown categories are missing."""
    schema = ", ".join([f"{c} {dict(rows.dtypes)[c]}" for c in keep] + ["x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [{v: k for k, v in enumerate(values, 1)} for _, values in of.categories]
        for b in batches:
            x = np.zeros((b.num_rows, len(of.names)), "<u2")
            for k, ((name, _), code) in enumerate(zip(of.categories, codes, strict=True)):
                x[:, k] = [code.get(v, 0) for v in b.column(name).to_pylist()]
            for k, (name, edges) in enumerate(of.numbers, len(codes)):
                v = b.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
                x[:, k] = np.where(np.isnan(v), 0, np.searchsorted(edges, v) + 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], names=[*keep, "x"])

    return rows.select(*dict.fromkeys([*keep, *of.names])).mapInArrow(run, schema)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_bag(keys: np.ndarray, round_: int, p: Boosting) -> np.ndarray:
    """Which rows a round looks at: it depends on the row's key, the round and the seed alone."""
    salt = _mix(np.array([p.seed * 1_000_003 + round_], np.uint64))
    return (_mix(keys.view(np.uint64) ^ salt) >> np.uint64(11)) < np.uint64(int(p.row_share * 2**53))


def in_round(features: int, round_: int, p: Boosting) -> np.ndarray:
    """Which features a round looks at."""
    order = np.argsort(_mix(np.arange(features, dtype=np.uint64) + np.uint64((p.seed + 7) * 1_000_003 + round_ * 4096)))
    out = np.zeros(features, bool)
    out[order[: max(1, round(features * p.column_share))]] = True
    return out


def gradients(f: np.ndarray, y: np.ndarray, w: np.ndarray, p: Boosting) -> np.ndarray:
    return w * (np.sign(f - y) if p.loss == "absolute" else f - y)


def histogram(x: np.ndarray, g: np.ndarray, w: np.ndarray, width: int) -> np.ndarray:
    """(3, features, width): sums of gradients and weights, and numbers of rows, by feature and bin. `x` has each
    feature's bins in a range of its own."""
    n = x.shape[1]
    flat = x.ravel()
    out = np.empty((3, n * width))
    for k, weights in enumerate((np.repeat(g, n), np.repeat(w, n), None)):
        out[k] = np.bincount(flat, weights, n * width)
    return out.reshape(3, n, width)


@dataclass
class Split:
    gain: float
    feature: int
    left: np.ndarray  # by bin: whether it goes left
    rows: tuple[int, int]  # left and right


def best_split(hist: np.ndarray, n_categories: int, columns: np.ndarray, p: Boosting) -> Split | None:
    """The split of most gain, if any gains: of equal ones the first by kind, side of missing values, feature and bin."""
    g, w, n = hist[:, 0].sum(axis=1).tolist()
    best: tuple[float, int, np.ndarray, tuple[int, int]] | None = None

    def gains(left: np.ndarray, l2: float) -> np.ndarray:
        ok = (left[2] >= p.least_rows) & (left[2] <= n - p.least_rows) & (left[1] >= p.least_weight) & (left[1] <= w - p.least_weight)
        out = left[0] ** 2
        out /= left[1] + l2
        right = g - left[0]
        right *= right
        right /= (w + l2) - left[1]
        out += right
        out -= g * g / (w + l2)
        out *= ok
        return out

    def offer(found: float, feature: int, goes: np.ndarray, n_left: float) -> None:
        nonlocal best
        if found > 1e-12 and (best is None or found > best[0]):
            best = found, feature, goes, (int(n_left), int(n - n_left))

    for k in np.flatnonzero(columns[:n_categories]).tolist():
        own = np.flatnonzero(hist[2, k, 1:] > 0) + 1
        if len(own):
            order = own[np.argsort(hist[0, k, own] / (hist[1, k, own] + p.smooth), kind="stable")]
            left = np.cumsum(hist[:, k, order], axis=1)
            found = gains(left, p.l2 + p.category_l2)
            at = int(found.argmax())
            goes = np.zeros(hist.shape[2], bool)
            goes[order[: at + 1]] = True
            offer(float(found[at]), k, goes, left[2, at])
    numbers = np.flatnonzero(columns[n_categories:]) + n_categories
    gaps = numbers[hist[2, numbers, 0] > 0]
    for features, with_missing in ((numbers, False), (gaps, True)):
        if len(features):
            left = np.cumsum(hist[:, features, 1:], axis=2)
            if with_missing:
                left += hist[:, features, :1]
            found = gains(left, p.l2)
            feature, at = divmod(int(found.argmax()), found.shape[1])
            goes = np.zeros(hist.shape[2], bool)
            goes[1 : at + 2], goes[0] = True, with_missing
            offer(float(found[feature, at]), int(features[feature]), goes, left[2, feature, at])
    return Split(*best) if best else None


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The least value up to which half of the weight lies."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return float(values[order[np.searchsorted(upto, 0.5 * upto[-1])]])


def first_value(y: np.ndarray, w: np.ndarray, p: Boosting) -> float:
    return weighted_median(y, w) if p.loss == "absolute" else float(np.average(y, weights=w))


def fit_predict(x: np.ndarray, y: np.ndarray, w: np.ndarray, keys: np.ndarray, n_categories: int, width: int, p: Boosting) -> np.ndarray:
    """The model's values of all rows; it learns from those whose y is not NaN. All in this task's memory."""
    train = ~np.isnan(y)
    out = np.zeros(len(y))
    if not train.any():
        return out
    out[:] = first_value(y[train], w[train], p)
    moved = x.astype(np.int64) + np.arange(x.shape[1]) * width
    for k in range(p.rounds):
        bag = train & in_bag(keys, k, p)
        columns = in_round(x.shape[1], k, p)
        g = gradients(out, y, w, p)
        for own, rest in _grown(x, moved, g, w, np.flatnonzero(bag), np.flatnonzero(~bag), n_categories, columns, width, p):
            if len(own):
                value = weighted_median((y - out)[own], w[own]) if p.loss == "absolute" else float(-g[own].sum() / (w[own].sum() + p.l2))
                out[own] += p.step * value
                out[rest] += p.step * value
    return out


def _grown(x: np.ndarray, moved: np.ndarray, g: np.ndarray, w: np.ndarray, own: np.ndarray, rest: np.ndarray, n_categories: int, columns: np.ndarray, width: int, p: Boosting) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The leaves of one tree: rows that it was grown from, and other rows that fall into it."""
    leaves: list[tuple] = []
    made = 0

    def open_(own: np.ndarray, rest: np.ndarray, hist: np.ndarray) -> None:
        nonlocal made
        split = best_split(hist, n_categories, columns, p) if len(own) >= 2 * p.least_rows else None
        heapq.heappush(leaves, (-split.gain if split else 0.0, made, own, rest, hist, split))
        made += 1

    open_(own, rest, histogram(moved[own], g[own], w[own], width))
    while len(leaves) < p.leaves and leaves[0][5]:
        _, _, own, rest, hist, split = heapq.heappop(leaves)
        a, b = (split.left[x[rows, split.feature]] for rows in (own, rest))
        parts = [(own[a], rest[b]), (own[~a], rest[~b])]
        less = int(len(parts[1][0]) < len(parts[0][0]))
        counted = histogram(moved[parts[less][0]], g[parts[less][0]], w[parts[less][0]], width)
        hists = (hist - counted, counted) if less else (counted, hist - counted)
        for (rows, others), h in zip(parts, hists, strict=True):
            open_(rows, others, h)
    return ((own, rest) for _, _, own, rest, _, _ in leaves)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), -1)


def _by_task(rows: DataFrame, n_categories: int, width: int, p: Boosting, keep: tuple[str, ...], types: dict[str, str]) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")  # sums do not depend on the order in which rows came
        y = table.column("label").to_numpy(zero_copy_only=False).astype(float)
        w = np.nan_to_num(table.column("weight").to_numpy(zero_copy_only=False).astype(float))
        got = fit_predict(_matrix(table.column("x")), y, w, table.column("key").to_numpy(), n_categories, width, p)
        at = np.flatnonzero(table.column("ahead").to_numpy(zero_copy_only=False))
        picked = table.select(["model", *keep]).take(pa.array(at))
        return picked.append_column("value", pa.array(got[at]))

    schema = ", ".join([f"model {types['model']}", *(f"{c} {types[c]}" for c in keep), "value double"])
    return rows.groupBy("model").applyInArrow(run, schema)


def boost(rows: DataFrame, of: Layout, p: Boosting, keep: tuple[str, ...] = (), in_memory: int = IN_MEMORY) -> DataFrame:
    """(model, `keep`..., value): what each model says of its rows `ahead`.

    `rows`: model, key (long, tells the rows of a model apart), x (of `binned`), label, weight, ahead (boolean), `keep`.
    A model learns from its rows that are not ahead, with a label and a weight above 0. A model that has none says 0.
    """
    rows = rows.withColumn("label", F.when(~F.col("ahead") & (F.col("weight") > 0), F.col("label").cast("double")))
    types = dict(rows.dtypes)
    rows = rows.select(*dict.fromkeys(["model", "key", "x", "label", "weight", "ahead", *keep]))
    sizes = written(rows.groupBy("model").agg(F.count("*").alias("n")), "sizes")
    large = sizes.filter(F.col("n") > in_memory).select("model")
    n_models, n_large = sizes.count(), large.count()
    out = None
    if n_models > n_large:
        # Four times as many partitions as models, so that few share one; a number that is given is not made smaller.
        small = rows.join(F.broadcast(large), "model", "left_anti").repartition(4 * n_models, "model")
        out = _by_task(small, len(of.categories), of.width, p, keep, types)
    if n_large:
        by_jobs = _by_jobs(rows.join(F.broadcast(large), "model", "left_semi"), of, p, keep)
        out = by_jobs if out is None else out.unionByName(by_jobs)
    return out if out is not None else rows.select("model", *keep, F.lit(0.0).alias("value"))


class Tree:
    """A tree while it grows: nodes by number, with the best split of each that has been looked at."""

    def __init__(self) -> None:
        self.splits: list[Split | None] = [None]
        self.children: list[tuple[int, int] | None] = [None]
        self.known = [False]
        self.sums: list[tuple[float, float]] = [(0.0, 0.0)]

    def expand(self, leaves: int) -> tuple[list[int], list[int]]:
        """Best first as far as splits are known: (leaves of the tree, those of them that have to be looked at)."""
        heap, done, unknown = [], [], []

        def put(k: int) -> None:
            if not self.known[k]:
                unknown.append(k)
            elif self.splits[k]:
                heapq.heappush(heap, (-self.splits[k].gain, k))
            else:
                done.append(k)

        put(0)
        while heap and len(heap) + len(done) + len(unknown) < leaves:
            k = heapq.heappop(heap)[1]
            if not self.children[k]:
                self.children[k] = len(self.splits), len(self.splits) + 1
                for part in (self.splits, self.children):
                    part += [None, None]
                self.known += [False, False]
                self.sums += [(0.0, 0.0)] * 2
            for c in self.children[k]:
                put(c)
        return done + unknown + [k for _, k in heap], unknown

    def compact(self, leaves: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, or -1 of a leaf; table by bin; children) by node: what tasks need to place rows."""
        ends = set(leaves)
        feature = np.array([-1 if k in ends or not s or not self.children[k] else s.feature for k, s in enumerate(self.splits)])
        width = max((len(s.left) for s in self.splits if s), default=1)
        tables = np.zeros((len(feature), width), bool)
        for k in np.flatnonzero(feature >= 0):
            tables[k] = self.splits[k].left
        return feature, tables, np.array([c or (0, 0) for c in self.children])


def placed(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The leaf of each row."""
    feature, tables, children = tree
    node = np.zeros(len(x), np.int64)
    todo = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(todo):
        at = node[todo]
        left = tables[at, x[todo, feature[at]]]
        node[todo] = np.where(left, children[at, 0], children[at, 1])
        todo = todo[feature[node[todo]] >= 0]
    return node


def _models(b: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    """The models of a batch and the places of their rows."""
    names = b.column("model").to_pylist()
    for name in dict.fromkeys(names):
        yield name, np.array([k for k, m in enumerate(names) if m == name])


def _by_jobs(rows: DataFrame, of: Layout, p: Boosting, keep: tuple[str, ...]) -> DataFrame:
    """Rounds of jobs. The driver holds the trees of a round, whose size the parameters set; rows stay in tables."""
    spark, kind, n_categories, width = rows.sparkSession, dict(rows.dtypes)["model"], len(of.categories), of.width
    begin = _medians(rows.filter("label IS NOT NULL").select("model", F.lit(0).alias("leaf"), F.col("label").alias("value"), "weight"))
    if p.loss == "squared":
        begin = rows.filter("label IS NOT NULL").groupBy("model").agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("value"))
    state = rows.join(F.broadcast(begin.select("model", F.col("value").alias("f"))), "model", "left")
    state = written(state.withColumn("f", F.coalesce("f", F.lit(0.0))), "boosted")
    models = [r.model for r in state.select("model").distinct().collect()]  # models are few: the caller made them
    for k in range(p.rounds):
        trees, columns, tables = {m: Tree() for m in models}, in_round(len(of.names), k, p), []
        # By model: nodes to count, with the sibling and the parent of each. The root has neither.
        wanted: dict[object, dict[int, tuple[int, int] | None]] = {m: {0: None} for m in models}
        while any(wanted.values()):
            found = _histograms(state, {m: (t.compact(_open(t)), wanted[m]) for m, t in trees.items()}, k, p, width, kind)
            if tables:
                found = found.unionByName(_parents(tables, wanted, kind))
            merged = found.repartition("model", "node").sortWithinPartitions("model", "node", "part").mapInArrow(_merged(n_categories, columns, p), f"model {kind}, node int, hist binary, gain double, feature int, goes binary, n_left long, n_right long, g double, w double")
            tables.append(written(merged, "histograms"))
            for r in tables[-1].drop("hist").collect():
                t = trees[r.model]
                t.known[r.node], t.sums[r.node] = True, (r.g, r.w)
                if r.gain > 0:
                    t.splits[r.node] = Split(r.gain, r.feature, np.frombuffer(r.goes, bool), (r.n_left, r.n_right))
            for m, t in trees.items():
                unknown, wanted[m] = set(t.expand(p.leaves)[1]), {}
                for parent, children in enumerate(t.children):
                    if children and children[0] in unknown:
                        less = int(t.splits[parent].rows[1] < t.splits[parent].rows[0])
                        wanted[m][children[less]] = children[1 - less], parent
        final = {m: (t.compact(leaves := t.expand(p.leaves)[0]), leaves) for m, t in trees.items()}
        if p.loss == "absolute":
            values = {(r.model, r.leaf): r.value for r in _medians(_residuals(state, {m: c for m, (c, _) in final.items()}, k, p, kind)).collect()}
        else:
            values = {(m, n): -trees[m].sums[n][0] / (trees[m].sums[n][1] + p.l2) for m, (_, leaves) in final.items() for n in leaves}
        after = written(_moved(state, {m: (c, {n: p.step * values.get((m, n), 0.0) for n in leaves}) for m, (c, leaves) in final.items()}), "boosted")
        discard(state, *tables)
        state = after
    return state.filter("ahead").select("model", *keep, F.col("f").alias("value"))


def _open(t: Tree) -> list[int]:
    """Nodes without children: the leaves of a tree that is not finished, among them those that may be split later."""
    return [k for k, c in enumerate(t.children) if not c]


def _histograms(state: DataFrame, trees: dict, round_: int, p: Boosting, width: int, kind: str) -> DataFrame:
    """(model, node, part, hist): of each task a row for a counted node, and one that takes it from its sibling's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        own = None
        for whole in batches:
            own = whole.column("model").type
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                y = b.column("label").to_numpy(zero_copy_only=False).astype(float)
                w, f = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("weight", "f"))
                use = ~np.isnan(y) & in_bag(b.column("key").to_numpy(), round_, p)
                x, g = _matrix(b.column("x")), gradients(f, y, w, p)
                for model, rows in _models(b):
                    tree, wanted = trees[model]
                    rows = rows[use[rows]]
                    node = placed(x[rows], tree)
                    for n in wanted:
                        here = rows[node == n]
                        h = histogram(x[here].astype(np.int64) + np.arange(x.shape[1]) * width, g[here], w[here], width)
                        total[model, n] = total[model, n] + h if (model, n) in total else h
        for (model, n), h in total.items():
            pair = trees[model][1][n]
            rows = [(n, PLUS, h.astype(float))] + ([(pair[0], MINUS, -h.astype(float))] if pair else [])
            cols = [pa.array([model] * len(rows), own), *(pa.array([r[c] for r in rows], pa.int32()) for c in (0, 1)), pa.array([r[2].tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["model", "node", "part", "hist"])

    return state.select("model", "key", "x", "label", "weight", "f").mapInArrow(run, f"model {kind}, node int, part int, hist binary")


def _parents(tables: list[DataFrame], wanted: dict, kind: str) -> DataFrame:
    """The parents' sums, as rows of the siblings of what is counted."""
    pairs = [(m, *pair) for m, own in wanted.items() for pair in own.values()]
    known = F.broadcast(tables[0].sparkSession.createDataFrame(pairs, f"model {kind}, sibling int, node int"))
    before = reduce(DataFrame.unionByName, (t.select("model", "node", "hist") for t in tables))
    return before.join(known, ["model", "node"]).select("model", F.col("sibling").alias("node"), F.lit(PARENT).alias("part"), "hist")


def _merged(n_categories: int, columns: np.ndarray, p: Boosting):
    """The sum of the rows of each (model, node), and its best split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out() -> pa.RecordBatch:
            hist = total.reshape(3, len(columns), -1)
            split = best_split(hist, n_categories, columns, p) if hist[2, 0].sum() >= 2 * p.least_rows else None
            g, w = hist[:2, 0].sum(axis=1).tolist()
            row = [key[0], key[1], total.tobytes(), split.gain if split else 0.0, split.feature if split else -1, split.left.tobytes() if split else b"", *(split.rows if split else (0, 0)), g, w]
            types = [kind, pa.int32(), pa.binary(), pa.float64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["model", "node", "hist", "gain", "feature", "goes", "n_left", "n_right", "g", "w"])

        for b in batches:
            kind = b.column("model").type
            for model, node, data in zip(*(b.column(c).to_pylist() for c in ("model", "node", "hist")), strict=True):
                h = np.frombuffer(data)
                if key is not None and key != (model, node):
                    yield out()
                    total = None
                key, total = (model, node), h if total is None else total + h
        if key is not None:
            yield out()

    return run


def _residuals(state: DataFrame, trees: dict, round_: int, p: Boosting, kind: str) -> DataFrame:
    """(model, leaf, value, weight): what is left to explain of the rows of this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, f = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "f"))
            use, x, leaf = ~np.isnan(y) & in_bag(b.column("key").to_numpy(), round_, p), _matrix(b.column("x")), np.zeros(b.num_rows, np.int32)
            for model, rows in _models(b):
                leaf[rows] = placed(x[rows], trees[model])
            got = pa.RecordBatch.from_arrays([b.column("model"), pa.array(leaf), pa.array(y - f), b.column("weight").cast(pa.float64())], names=["model", "leaf", "value", "weight"])
            yield got.filter(pa.array(use))

    return state.select("model", "key", "x", "label", "weight", "f").mapInArrow(run, f"model {kind}, leaf int, value double, weight double")


def _medians(rows: DataFrame) -> DataFrame:
    """(model, leaf, value): weighted medians of (model, leaf, value, weight). Equal values are added up first."""
    sums = rows.groupBy("model", "leaf", "value").agg(F.sum("weight").alias("weight"))
    own = Window.partitionBy("model", "leaf")
    upto = F.sum("weight").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    half = sums.select("model", "leaf", "value", upto.alias("upto"), (F.sum("weight").over(own) * 0.5).alias("half"))
    return half.filter("upto >= half").groupBy("model", "leaf").agg(F.min("value").alias("value"))


def _moved(state: DataFrame, trees: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, x = b.column("f").to_numpy().copy(), _matrix(b.column("x")) if b.num_rows else None
            for model, rows in _models(b):
                tree, values = trees[model]
                by_node = np.zeros(len(tree[0]))
                by_node[list(values)] = list(values.values())
                f[rows] += by_node[placed(x[rows], tree)]
            at = b.schema.get_field_index("f")
            yield b.set_column(at, "f", pa.array(f))

    return state.mapInArrow(run, state.schema)
