"""Boosted trees against a plain learner, and jobs against single tasks."""

import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators.boosting import Boosting, Layout, Tree, best_split, binned, boost, fit_predict, histogram, in_bag, in_round, layout, weighted_median

SMALL = Boosting(rounds=4, leaves=9, step=0.5, least_rows=5)


def plain(x, y, w, keys, n_categories, p):
    """Rounds, leaves and splits one by one: every candidate's rows are selected and added up anew."""
    rows = range(len(y))
    train = [k for k in rows if not math.isnan(y[k])]

    def median(pairs):
        half, upto = sum(b for _, b in pairs) / 2, 0.0
        for value, weight in sorted(pairs):
            upto += weight
            if upto >= half:
                return value

    f0 = median([(y[k], w[k]) for k in train]) if p.loss == "absolute" else sum(y[k] * w[k] for k in train) / sum(w[k] for k in train)
    f = [f0] * len(y)
    for round_ in range(p.rounds):
        bag, columns = in_bag(np.array(keys), round_, p), in_round(len(x[0]), round_, p)
        g = [w[k] * ((f[k] > y[k]) - (f[k] < y[k]) if p.loss == "absolute" else f[k] - y[k]) if not math.isnan(y[k]) else 0 for k in rows]

        def sums(own, g=g):
            return sum(g[k] for k in own), sum(w[k] for k in own), len(own)

        def best(own, columns=columns, sums=sums, g=g):
            """(gain, feature, bins that go left)"""
            total, found = sums(own), (1e-12, None, None)
            if total[2] < 2 * p.least_rows:
                return found
            for kind in ("category", "number", "missing left"):
                for j in range(len(x[0])):
                    if not columns[j] or (j < n_categories) != (kind == "category"):
                        continue
                    bins = sorted({x[k][j] for k in own} - {0})
                    extra = {0} if kind == "missing left" else set()
                    if extra and not any(x[k][j] == 0 for k in own):
                        continue
                    if kind == "category":
                        ratio = {b: sums([k for k in own if x[k][j] == b]) for b in bins}
                        bins.sort(key=lambda b: (ratio[b][0] / (ratio[b][1] + p.smooth), b))
                    for n in range(1, len(bins) + 1):
                        left = set(bins[:n]) | extra
                        a = sums([k for k in own if x[k][j] in left])
                        b = tuple(t - s for t, s in zip(total, a, strict=True))
                        if min(a[2], b[2]) < p.least_rows or min(a[1], b[1]) < p.least_weight:
                            continue
                        l2 = p.l2 + (p.category_l2 if kind == "category" else 0)
                        gain = a[0] ** 2 / (a[1] + l2) + b[0] ** 2 / (b[1] + l2) - total[0] ** 2 / (total[1] + l2)
                        if gain > found[0] + 1e-9:
                            # A number's threshold holds for bins that this leaf does not have, too.
                            known = left if kind == "category" else set(range(1, bins[n - 1] + 1)) | extra
                            found = gain, j, known
            return found

        own = [k for k in train if bag[k]]
        leaves = [(best(own), own, [k for k in rows if k not in set(own)])]
        while len(leaves) < p.leaves:
            at = max(range(len(leaves)), key=lambda k: leaves[k][0][0])
            (gain, j, left), own, rest = leaves[at]
            if j is None:
                break
            parts = [([k for k in s if x[k][j] in left], [k for k in s if x[k][j] not in left]) for s in (own, rest)]
            leaves[at : at + 1] = [(best(parts[0][s]), parts[0][s], parts[1][s]) for s in (0, 1)]
        new = list(f)
        for _, own, rest in leaves:
            if own:
                value = median([(y[k] - f[k], w[k]) for k in own]) if p.loss == "absolute" else -sum(g[k] for k in own) / (sum(w[k] for k in own) + p.l2)
                for k in own + rest:
                    new[k] = f[k] + p.step * value
        f = new
    return f


def made(n, seed=0):
    """Two categories and three numbers, some missing; targets and weights are whole numbers, so sums are exact."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 7, n), rng.integers(1, 4, n), *(rng.integers(0, 20, n) for _ in range(3))], axis=1).astype("<u2")
    y = np.rint(4.0 * (x[:, 2] > 11) + 3 * np.isin(x[:, 0], (1, 4)) - 2.0 * (x[:, 3] == 0) + rng.normal(size=n))
    w = rng.integers(1, 9, n).astype(float)
    y[rng.random(n) < 0.1] = np.nan
    return x, y, w, rng.permutation(n).astype(np.int64) * 7919


@pytest.mark.parametrize("loss", ["absolute", "squared"])
def test_equal_to_a_plain_learner(loss):
    x, y, w, keys = made(220)
    for p in (replace(SMALL, loss=loss), replace(SMALL, loss=loss, rounds=2, leaves=127, least_rows=2, row_share=1.0, column_share=1.0)):
        got = fit_predict(x, y, w, keys, 2, 20, p)
        assert np.allclose(got, plain(x.tolist(), y.tolist(), w.tolist(), keys.tolist(), 2, p), atol=1e-9)


def frame(spark, n_models=3, n=400):
    rows = []
    for m in range(n_models):
        x, y, w, keys = made(n, m)
        rows += [(m, int(k), bytearray(b.tobytes()), None if math.isnan(t) else float(t), float(v), math.isnan(t)) for b, t, v, k in zip(x, y, w, keys, strict=True)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "model int, key long, x binary, label double, weight double, ahead boolean").repartition(5)


OF = Layout(tuple((f"n{k}", tuple(float(v) for v in range(18))) for k in range(3)), (("a", tuple("abcdef")), ("b", tuple("xyz"))))


@pytest.mark.parametrize("loss", ["absolute", "squared"])
def test_jobs_and_tasks_grow_the_same_trees(spark, loss):
    """All models by tasks, all by jobs, and some by each; against the learner on one model's rows."""
    df, p = frame(spark), replace(SMALL, loss=loss, rounds=2, leaves=7)
    by_task, by_jobs = ({(r.model, r.key): r.value for r in boost(df, OF, p, ("key",), limit).collect()} for limit in (10**6, 0))
    assert by_task.keys() == by_jobs.keys() and len(by_task) > 60
    assert all(abs(by_task[k] - by_jobs[k]) < 1e-9 for k in by_task)
    x, y, w, keys = made(400, 1)
    want = dict(zip(keys.tolist(), fit_predict(x, y, w, keys, 2, OF.width, p), strict=True))
    assert all(abs(v - want[key]) < 1e-12 for (m, key), v in by_task.items() if m == 1)
    some = df.filter("model > 0 OR key % 3 = 0")
    assert boost(some, OF, p, ("key",), 300).count() == some.filter("ahead").count()


def test_models_without_rows(spark):
    df = frame(spark, 1, 50)
    p = replace(SMALL, rounds=1, leaves=2)
    assert {r.value for r in boost(df.withColumn("label", F.lit(None).cast("double")), OF, p).collect()} == {0.0}
    assert {r.value for r in boost(df.withColumn("label", F.lit(None).cast("double")), OF, p, (), 0).collect()} == {0.0}
    assert boost(df.limit(0), OF, p).count() == 0
    assert {r.value for r in boost(df.withColumn("label", F.lit(3.0)), OF, p).collect()} == {3.0}


def test_weighted_median():
    assert weighted_median(np.array([5.0, 1.0, 3.0]), np.array([1.0, 1.0, 1.0])) == 3.0
    assert weighted_median(np.array([5.0, 1.0, 3.0]), np.array([4.0, 1.0, 1.0])) == 5.0
    assert weighted_median(np.array([2.0, 1.0]), np.array([1.0, 1.0])) == 1.0


def test_missing_values_go_where_they_gain():
    x = np.array([[0], [0], [1], [1], [2], [2]], np.int64)
    p = Boosting(least_rows=1)
    for g, missing_left in (([9, 9, 9, 9, -9, -9], True), ([-9, -9, 9, 9, -9, -9], False)):
        split = best_split(histogram(x, np.array(g, float), np.ones(6), 4), 0, np.ones(1, bool), p)
        assert split.left[:3].tolist() == [missing_left, True, False]
    assert best_split(histogram(x, np.zeros(6), np.ones(6), 4), 0, np.ones(1, bool), p) is None


def test_best_first_looks_again():
    """A child that gains more than a split chosen before it was known takes its place."""
    t = Tree()
    gain = {0: 9.0, 1: 5.0, 2: 1.0, 3: 4.0, 4: 0.0, 5: 3.0, 6: 0.0}
    from quern.operators.boosting import Split

    looked = []
    while unknown := t.expand(4)[1]:
        looked += unknown
        for k in unknown:
            t.known[k] = True
            if gain.get(k):
                t.splits[k] = Split(gain[k], 0, np.ones(2, bool), (9, 9))
    leaves = t.expand(4)[0]
    assert len(leaves) == 4 and {k for k in range(len(t.splits)) if k not in leaves and t.children[k]} >= {0, 1, 3}


def test_bins(spark):
    rows = [(1.0, "a"), (2.0, "b"), (None, None), (float("nan"), "b"), (3.0, "c"), (99.0, "a")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "key int, v double, c string")
    of = layout(df, ("v",), ("c",), 4)
    got = {r.key: np.frombuffer(r.x, "<u2").tolist() for r in binned(df, of, ("key",)).collect()}
    assert got[2] == [0, 0] and got[3][1] == 0 and [got[k][0] for k in (0, 1, 4, 5)] == [1, 2, 3, 1]
    assert got[0][1] < got[1][1] <= got[4][1] <= got[5][1] and of.width >= 4
    later = binned(spark.createDataFrame([(0, -5.0, "z")], "key int, v double, c string"), of, ("key",)).first()
    assert np.frombuffer(later.x, "<u2").tolist() == [0, 1]


def test_later_days_do_not_change_a_cutoff(spark):
    from quern.plans import trees as T
    from quern.plans.queries import World

    first, later = "1997-01-13", "1997-06-02"
    p = Boosting(rounds=3, leaves=15)
    got = {}
    for dates in ((first,), (first, later)):
        w = World(spark, "/root/testdata/sf0.01", dates=dates)
        got[dates] = {(r.series_id, r.date): r.yhat for r in T.gradient_boosted(w.inputs, p).collect() if r.cutoff == dt.date.fromisoformat(first)}
    a, b = got.values()
    assert len(a) == 210 and any(a.values()) and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_blends_of_heads(spark):
    from quern.plans import forecast as P
    from quern.plans import trees as T
    from quern.plans.queries import World

    x, p = World(spark, "/root/testdata/sf0.01", dates=("1999-05-10",)).inputs, Boosting(rounds=2, leaves=5)
    by_cell = lambda df: {(r.series_id, r.date): r.yhat for r in df.collect()}
    hand, l1, l2 = (by_cell(df) for df in (P.hand(x), *T.heads(x, p)))
    thirds, full = by_cell(T.thirds(x, p)), by_cell(T.full_blend(x, p))
    assert len(thirds) == len(full) == 210 and l1 != l2
    assert all(abs(thirds[k] - (hand[k] + l1[k] + l2[k]) / 3) < 1e-9 for k in thirds)
    assert all(min(hand[k], l1[k], l2[k]) - 1e-9 <= full[k] <= max(hand[k], l1[k], l2[k]) + 1e-9 for k in full)
    assert {"gbt", "gbt_first", "gbt_squared", "thirds", "full_blend"} <= T.ALL.keys()
