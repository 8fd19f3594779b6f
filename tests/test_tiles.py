"""Kernels by tiles against exact distances, and the operators on them at several blocks."""

import numpy as np
import pytest

from taxolens.operators import neighbors as N
from taxolens.operators.clustering import dbscan as D


def _sets():
    rng = np.random.default_rng(0)
    grid = np.round(rng.uniform(0, 20, (700, 2)), 1) + 1000.0  # many pairs exactly eps apart, far from 0
    high = rng.normal(size=(500, 40))
    high[10:30] = high[5]
    return [(grid, 1.5), (high, 8.5), (rng.normal(size=(300, 6)).round(1), 1.0)]


@pytest.mark.parametrize("k", range(3))
def test_tiles_equal_exact_distances(monkeypatch, k):
    monkeypatch.setattr(N, "TILE_ROWS", 128)
    X, eps = _sets()[k]
    exact = N.pair_distances(X, X)
    got = np.zeros_like(exact, dtype=bool)
    for i, j, ok in N.near_tiles(X, X, eps, 128):
        got[np.ix_(i, j)] = ok
    assert (got == (exact <= eps)).all()
    assert (N.near_counts(X, X, eps) == (exact <= eps).sum(axis=1)).all()
    assert (N.k_least(X, X, 5) == np.sort(exact, axis=1)[:, :5]).all()
    for i, j, d in N.distance_tiles(X, X):
        assert np.allclose(d, exact[i, j], rtol=1e-9, atol=1e-9)
    ids = np.arange(len(X))[::-1].copy()
    w = np.arange(len(X)) % 5 + 1.0
    cost = w[:, None] * w / (w[:, None] + w) * exact ** 2
    cost[np.eye(len(X), dtype=bool)] = np.inf
    best, other, _ = N.least_cost(X, X, ids, ids, (w, w))
    assert (best == cost.min(axis=1)).all()
    assert (other == np.where(cost == best[:, None], ids, len(X)).min(axis=1)).all()


def test_labels_join_over_tiles():
    X = np.linspace(0, 300, 900)[:, None]
    labels, at = np.arange(900), np.arange(900)
    for i, j, ok in N.near_tiles(X, X, 0.5, 100):
        labels = N.join_tile(labels, at[i], at[j], ok)
    assert (labels == 0).all()


def test_pivots_only_where_they_pay(spark):
    rng = np.random.default_rng(1)
    def frame(X):
        return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>")
    # 64 dimensions, eps near the distances: copies would be pivots × rows (the executors ran out of memory)
    assert D.n_pivots(frame(rng.normal(size=(600, 64))), 11.0, "features", 20, 600)[0] == 1
    # more rows in the same plane: cells do not get narrower than eps
    m, copies = D.n_pivots(frame(rng.uniform(0, 60, (6000, 2))), 1.5, "features", 8, 6000)
    assert 1 < m and copies < 10


def test_dbscan_blocks_of_a_cell(spark, monkeypatch):
    X = np.concatenate([np.random.default_rng(2).normal(c, 0.3, (80, 2)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>")
    whole = sorted(map(tuple, D.dbscan(df, 0.4, 4).collect()))
    monkeypatch.setattr(N, "BLOCK_ROWS", 25)
    monkeypatch.setattr(D, "COPY_PAIRS", 0)
    assert sorted(map(tuple, D.dbscan(df, 0.4, 4, block_rows=20).collect())) == whole
