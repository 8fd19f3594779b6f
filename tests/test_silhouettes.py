"""Silhouettes of several labelings from one pass over pairs of rows."""

import numpy as np
import pytest

from conftest import SF_SMALL
from taxolens.operators import vectors as V
from taxolens.plans.catalog import q_models


def _slow(X, y):
    D, s = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), []
    for i in range(len(X)):
        own = y == y[i]
        a = D[i, own].sum() / max(1, own.sum() - 1)
        b = min(D[i, y == c].mean() for c in np.unique(y) if c != y[i])
        s.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    return np.mean(s)


@pytest.mark.parametrize("block_rows", [None, 37])
def test_several_labelings_share_the_pairs(spark, block_rows):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(150, 5))
    X[20:23] = X[7]
    y = {"a": rng.integers(-1, 4, 150), "b": np.arange(150) // 50, "one": np.zeros(150, int), "all": np.arange(150),
         "many": np.arange(150) // 2}
    rows = [(i, X[i].tolist(), *(int(c[i]) for c in y.values())) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, " + ", ".join(f"{c} int" for c in y))
    got = V.silhouettes(df, list(y), block_rows=block_rows).first()
    assert got["one"] is None and got["all"] is None  # fewer than 2 clusters, more than n - 1
    for c in ("a", "b", "many"):  # many: more clusters than sums are columns
        assert got[c] == pytest.approx(_slow(X, y[c]), abs=1e-9)


def test_odd_rows_count_as_for_many_clusters(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=3).tolist(), int(c)) for i, c in enumerate(rng.integers(0, 5, 90))]
    rows += rows[:7] + [(11, rows[3][1], 2), (11, rows[4][1], 3)]  # repeated rows, a repeated id
    rows += [(None, rows[5][1], 1), (200, rows[6][1], None)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, cluster int").cache()
    few = V.silhouette(df, block_rows=20).first()[0]
    monkeypatch.setattr(V, "SUM_COLUMNS", 1)
    assert few == pytest.approx(V.silhouette(df, block_rows=20).first()[0], abs=1e-12)


def test_report_compares_rows_once_for_all_labelings(spark, monkeypatch):
    passes, pairs = [], V.block_pairs
    monkeypatch.setattr(V, "block_pairs", lambda *a, **k: passes.append(1) or pairs(*a, **k))
    assert q_models.q_results_table(spark, SF_SMALL).count() == 3
    assert len(passes) == 1
