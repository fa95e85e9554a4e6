"""Embedding near-duplicates against all pairs in double precision."""

import numpy as np
import pytest

from quern.llm import tileproduct as T
from quern.llm.components import Forest
from quern.llm.tileproduct import embedding_duplicates, op13_embedding_neardup, quantised, tile_links, unit


def brute(rows, least=0.9):
    """(id, links, component, kept) of each row, from the matrix of cosines."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = {k: k for k in good}, dict.fromkeys(good, 0)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for dims in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == dims]
        x = np.array([rows[k][1] for k in own], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            links[own[a]] += 1
            links[own[b]] += 1
            p, q = root(own[a]), root(own[b])
            parent[max(p, q)] = min(p, q)
    first: dict = {}
    for k in good:
        first[root(k)] = min(first.get(root(k), rows[k][0]), rows[k][0])
    component = [first[root(k)] if k in parent else i for k, (i, _) in enumerate(rows)]
    return sorted(((i, links.get(k, 0), c, i is None or i == c) for k, ((i, _), c) in enumerate(zip(rows, component, strict=True))), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def small_tiles(monkeypatch):
    monkeypatch.setattr(T, "LEAST_TILE", 20)
    monkeypatch.setattr(T, "CELLS", 500)


def odd_rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(k if k % 50 else 7, (centres[k % 12] + rng.normal(size=16) * 0.42).tolist()) for k in range(300)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0] * 15 + [None]), (404, [float("nan")] * 16), (405, [float("inf")] * 16)]
    rows += [(None, rows[3][1]), (406, rows[3][1]), (406, rows[3][1]), (407, [2 * x for x in rows[3][1]]), (408, [-0.0, 1.0] * 8), (409, [0.0, 1.0] * 8)]
    return rows + [(410, [1e300] * 16), (411, [1e-300] * 16), (412, [1.0, 2.0]), (413, [1.0, 2.1]), (414, [3.0])]


@pytest.mark.parametrize("least", [0.8, 0.9, 0.95])
def test_odd_rows(spark, small_tiles, least):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, weight int, digest string").repartition(5)
    assert collected(embedding_duplicates(df, least)) == brute(rows, least)


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert collected(embedding_duplicates(df)) == [(1, 0, 1, True)]
    assert collected(embedding_duplicates(df.limit(0))) == []
    with pytest.raises(ValueError):
        embedding_duplicates(df, 0.0)


def test_given_embeddings(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    assert collected(op13_embedding_neardup(spark, at)) == brute(rows)


def test_a_third_of_rows_are_copies(spark, small_tiles):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).tolist()
    rows = [(k, hot if k % 3 == 0 else (np.array(hot) + rng.normal(size=8) * 0.05).tolist() if k % 3 == 1 else rng.normal(size=8).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert collected(embedding_duplicates(df)) == brute(rows)


@pytest.mark.parametrize("dims", [3, 64, 2500])
def test_bounds_hold(dims):
    """No pair is on the other side of a threshold than the bounds say."""
    rng = np.random.default_rng(dims)
    u = unit(rng.normal(size=(60, dims)) * rng.choice([1, 30], (60, dims)))
    q, scale, left = quantised(u)
    exact, near = u @ u.T, (q.astype(np.int64) @ q.T.astype(np.int64)) * scale[:, None] * scale
    assert (np.abs(exact - near) <= left[:, None] + left * (1 + left[:, None])).all()
    assert (T._product(q.astype(np.float32), q.astype(np.float32)) == q.astype(np.int64) @ q.T.astype(np.int64)).all()


def test_pairs_between_the_bounds_are_computed_alone():
    """Vectors about the threshold: what the first pass leaves open is exactly what the second decides."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=32)
    u = unit(base + rng.normal(size=(200, 32)) * 0.47)
    q, scale, left = quantised(u)
    rows = {"q": q, "scale": scale, "left": left, "weight": np.ones(200, np.int64), "c": np.arange(200), "u": u}
    sure, _, _, unsure = tile_links(rows, 0, 0.9, False)
    exact, _, _, _ = tile_links(rows, 0, 0.9, True)
    want = (u @ u.T >= 0.9).sum(axis=0) - 1
    assert (sure + exact == want).all() and 0 < unsure.sum() and 0 < exact.sum() < want.sum()
    parts = {k: v[unsure] for k, v in rows.items()}
    assert (tile_links(parts, 0, 0.9, True)[0] == exact[unsure]).all()


def test_forest():
    f = Forest(6)
    f.link(np.array([5, 3, 1]), np.array([3, 1, 5]))
    f.link(np.array([4]), np.array([0]))
    assert f.parent.tolist() == [0, 1, 2, 1, 0, 1]
