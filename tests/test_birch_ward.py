"""BIRCH CF invariants and Ward exactness against a naive implementation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from taxolens.operators.clustering.birch import absorb, birch, cf_build, cf_radius
from taxolens.operators.clustering.ward import ward_groups
from taxolens.plans import fixtures as FX


@pytest.mark.parametrize("cell_rows", [4096, 60])
def test_cf_invariants_for_any_partitions(spark, cell_rows):
    v = FX.vectors(spark, SF_MID).select("row_id", "features")
    v = v.unionByName(v.filter("row_id < 40").withColumn("row_id", F.col("row_id") + 5000))  # repeated rows
    X = np.array([r["features"] for r in v.collect()])
    found = []
    for parts in (1, 4, 16):
        cfs = cf_build(v.repartition(parts, F.rand(parts)), 0.75, cell_rows=cell_rows)
        rows = sorted(map(tuple, cfs.select("first", "n", "ss", "ls").collect()))
        found.append(rows)
        r = cf_radius(cfs).agg(F.max("radius").alias("r")).first()
        assert r["r"] <= 0.75 + 1e-9 and 1 < len(rows) < len(X)
        assert sum(r[1] for r in rows) == len(X)
        assert np.allclose(sum(np.array(r[3]) for r in rows), X.sum(0))
        assert np.isclose(sum(r[2] for r in rows), (X * X).sum())
        assert len({r[0] for r in rows}) == len(rows)
    assert found[0] == found[1] == found[2]


def test_absorption_equals_a_slow_one():
    rng = np.random.default_rng(4)
    for t in (0.3, 1.0, 3.0):
        X = rng.normal(size=(60, 3)).round(1)
        left, slow = list(range(60)), []
        while left:
            order = sorted(left, key=lambda i: (i != left[0], ((X[i] - X[left[0]]) ** 2).sum(), i))
            own = order[:1]
            for i in order[1:]:
                Y = X[own + [i]]
                if ((Y - Y.mean(0)) ** 2).sum(1).mean() > t * t + 1e-12:
                    break
                own.append(i)
            slow.append((min(own), len(own)))
            left = [i for i in left if i not in own]
        got = absorb(np.arange(60), np.ones(60), X, (X * X).sum(1), t)
        assert [(f, n) for f, n, _, _ in got] == slow


def test_birch_labels_cover_rows(spark):
    v = FX.vectors(spark, SF_SMALL)
    lab = birch(v, threshold=0.75, n_clusters=5)
    assert lab.count() == v.count()
    assert lab.select("cluster").distinct().count() == 5


def _naive_ward(X, k):
    groups = [[i] for i in range(len(X))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                A, B = X[groups[a]], X[groups[b]]
                cost = len(A) * len(B) / (len(A) + len(B)) * ((A.mean(0) - B.mean(0)) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        _, a, b = best
        groups[a] += groups[b]
        del groups[b]
    lab = np.empty(len(X), dtype=int)
    for g, members in enumerate(sorted(groups, key=min)):
        lab[members] = g
    return lab


@pytest.mark.parametrize("seed,block_rows,k", [(0, 2048, 4), (1, 14, 4), (3, 2048, 24)])
def test_ward_exact_on_points(spark, seed, block_rows, k):
    X = np.random.default_rng(seed).normal(size=(25, 3))
    points = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(X)], "id long, n long, mean array<double>")
    got = {r["id"]: r["grp"] for r in ward_groups(points, k, block_rows).collect()}
    assert [got[i] for i in range(25)] == _naive_ward(X, k).tolist()


def test_ward_ties_and_few_summaries(spark):
    # a square of equal sides: the lower ids merge first
    rows = [(0, 1.0, [0.0, 0.0]), (1, 1.0, [0.0, 1.0]), (2, 1.0, [1.0, 0.0]), (3, 1.0, [1.0, 1.0])]
    square = spark.createDataFrame(rows, "id long, n double, mean array<double>")
    assert sorted(map(tuple, ward_groups(square, 2).collect())) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    same = spark.createDataFrame([(i, 1.0, [0.0]) for i in range(5)], "id long, n double, mean array<double>")
    assert ward_groups(same, 2).select("grp").distinct().count() == 2
    assert ward_groups(square.limit(0), 2).collect() == []
    assert [tuple(r) for r in ward_groups(square.limit(1), 3).collect()] == [(0, 0)]
