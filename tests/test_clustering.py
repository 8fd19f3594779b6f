"""Clustering operators vs independent numpy implementations."""

import itertools

import numpy as np
import pytest

from conftest import SF_SMALL
from taxolens.operators.assignment import max_weight_matching
from taxolens.operators.clustering.dbscan import dbscan
from taxolens.operators.neighbors import connected_components, local_components
from taxolens.operators.vectors import calinski_harabasz, davies_bouldin, silhouette
from taxolens.plans import fixtures as FX


def _np_dbscan(X, eps, ms):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = D <= eps
    core = nb.sum(1) >= ms
    lab = np.full(len(X), -1)
    c = 0
    for i in range(len(X)):
        if lab[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if lab[j] != -1:
                continue
            lab[j] = c
            if core[j]:
                stack.extend(np.nonzero(nb[j] & (lab == -1))[0].tolist())
        c += 1
    return lab


def _vectors(spark):
    pdf = FX.vectors(spark, SF_SMALL).orderBy("row_id").toPandas()
    return pdf, np.stack(pdf["features"].to_numpy())


@pytest.mark.parametrize("eps,ms", [(1.14, 3), (1.16, 5), (1.0, 1)])
def test_dbscan_matches_bfs(spark, eps, ms):
    pdf, X = _vectors(spark)
    got = dbscan(FX.vectors(spark, SF_SMALL), eps, ms, block_rows=64).toPandas()
    got = got.set_index("row_id").loc[pdf["row_id"], "cluster"].to_numpy()
    assert (got == _np_dbscan(X, eps, ms)).all()


def _plane(n, seed):
    """Clusters in the plane, a dense one that holds a third of the rows, repeated points and noise."""
    rng = np.random.default_rng(seed)
    hubs = rng.uniform(0, 100, (n // 60, 2))
    X = np.concatenate([rng.normal(hubs[rng.integers(0, len(hubs), n // 2)], 0.4), rng.normal([50, 50], 0.3, (n // 3, 2)),
                        rng.uniform(0, 100, (n - n // 2 - n // 3, 2))])
    X[:5] = X[5]
    return X


def _points(spark, X):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>")


def test_dbscan_cells_match_bfs(spark, monkeypatch):
    from taxolens.operators.clustering import dbscan as module
    monkeypatch.setattr(module, "SALT_ROWS", 100)
    X = _plane(600, 3)
    got = dbscan(_points(spark, X), 0.5, 4, block_rows=60).orderBy("row_id").toPandas()["cluster"].to_numpy()
    assert (got == _np_dbscan(X, 0.5, 4)).all()


def test_cells_copy_rows_alike_at_any_size(spark):
    from taxolens.operators.clustering import dbscan as module
    copies = []
    for n in (1000, 4000):
        X = np.random.default_rng(n).uniform(0, n ** 0.5, (n, 2))  # equal density
        cells = module._cells(_points(spark, X), 0.5, "features", 100, n)
        assert cells.filter("cell = home").select("row_id").distinct().count() == n
        assert cells.filter("cell = home").count() == n
        assert cells.select("cell").distinct().count() >= n // 50
        copies.append(cells.count() / n)
    assert copies[1] <= 1.25 * copies[0] <= 5


def test_internal_metrics_match_numpy(spark):
    pdf, X = _vectors(spark)
    lab = FX.vec_lab(spark, SF_SMALL)
    y = lab.orderBy("row_id").toPandas()["cluster"].to_numpy()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = y == y[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, y == c].mean() for c in np.unique(y) if c != y[i])
        s.append((b - a) / max(a, b))
    assert silhouette(lab, block_rows=64).first()[0] == pytest.approx(np.mean(s), abs=1e-9)
    ks = np.unique(y)
    C = np.array([X[y == k].mean(0) for k in ks])
    sp = np.array([np.linalg.norm(X[y == k] - C[i], axis=1).mean() for i, k in enumerate(ks)])
    dc = np.sqrt(((C[:, None] - C[None]) ** 2).sum(-1))
    np.fill_diagonal(dc, np.inf)
    db = np.mean(((sp[:, None] + sp[None]) / dc).max(1))
    assert davies_bouldin(lab).first()[0] == pytest.approx(db, abs=1e-9)
    g = X.mean(0)
    ssb = sum((y == k).sum() * ((C[i] - g) ** 2).sum() for i, k in enumerate(ks))
    ssw = sum(((X[y == k] - C[i]) ** 2).sum() for i, k in enumerate(ks))
    ch = ssb * (len(X) - len(ks)) / (ssw * (len(ks) - 1))
    assert calinski_harabasz(lab).first()[0] == pytest.approx(ch, rel=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_assignment_vs_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    m = int(rng.integers(n, 7))
    W = rng.integers(0, 9, (n, m)).astype(float)
    got = max_weight_matching(W)
    assert len(set(got)) == n
    best = max(sum(W[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    assert sum(W[i, got[i]] for i in range(n)) == best


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7), (9, 3)], "src long, dst long")
    got = {r["node"]: r["comp"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 7: 7}
    adj = np.zeros((4, 4), dtype=bool)
    adj[0, 3] = adj[3, 0] = True
    assert local_components(np.array([10, 11, 12, 13]), adj).tolist() == [10, 11, 12, 10]


def test_boruvka_mst_matches_prim(spark):
    from taxolens.operators.clustering.density import boruvka_mst, core_distances
    v = FX.vectors(spark, SF_SMALL).orderBy("row_id").limit(120)
    pdf = v.toPandas()
    X = np.stack(pdf["features"].to_numpy())
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    core = np.sort(D, axis=1)[:, 4]
    M = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    n = len(X)
    seen = np.zeros(n, bool)
    seen[0] = True
    best = M[0].copy()
    total = 0.0
    for _ in range(n - 1):
        cand = np.where(seen, np.inf, best)
        j = int(np.argmin(cand))
        total += cand[j]
        seen[j] = True
        best = np.minimum(best, M[j])
    cd = core_distances(v, 5, block_rows=40)
    mst = boruvka_mst(v, cd, block_rows=40).toPandas()
    assert len(mst) == n - 1
    assert mst["w"].sum() == pytest.approx(total, rel=1e-9)


def _slow_bisecting(X, k, max_iter):
    leaves = [np.arange(len(X))]
    inertia = lambda own: ((X[own] - X[own].mean(0)) ** 2).sum()
    while len(leaves) < k:
        own = max(leaves, key=inertia)
        a = X[own][((X[own] - X[own].mean(0)) ** 2).sum(1).argmax()]
        C = np.stack([a, X[own][((X[own] - a) ** 2).sum(1).argmax()]])
        for _ in range(max_iter):
            side = ((X[own][:, None] - C) ** 2).sum(2).argmin(1)
            new = np.stack([X[own][side == s].mean(0) for s in (0, 1)])
            if ((new - C) ** 2).sum(1).max() <= 1e-18:
                break
            C = new
        side = ((X[own][:, None] - C) ** 2).sum(2).argmin(1)
        leaves = [x for x in leaves if x is not own] + [own[side == 0], own[side == 1]]
    return {frozenset(x.tolist()) for x in leaves}


@pytest.mark.parametrize("k", [2, 6, 9])
def test_bisecting_splits_the_leaf_of_most_inertia(spark, k):
    from taxolens.operators.clustering.bisecting import bisecting_kmeans, bisecting_tree
    X = np.concatenate([np.random.default_rng(1).normal(c, s, (40, 2)) for c, s in ((0, 1), (8, 0.2), (20, 3), (-9, 0.5))])
    df = _points(spark, X).repartition(5)
    got = bisecting_kmeans(df, k).groupBy("cluster").agg({"row_id": "collect_list"}).collect()
    assert {frozenset(r[1]) for r in got} == _slow_bisecting(X, k, 20)
    assert bisecting_tree(df, k).largest_first(k)


def test_bisecting_with_equal_rows(spark):
    from taxolens.operators.clustering.bisecting import bisecting_kmeans
    df = _points(spark, np.array([[0.0, 1e6]] * 5 + [[1.0, 1e6]] * 3))
    assert bisecting_kmeans(df, 4).select("cluster").distinct().count() == 2
    assert bisecting_kmeans(df.limit(0), 4).collect() == []


def test_batches_are_drawn_once(spark):
    from taxolens.operators.clustering.minibatch import draw_batches, minibatch_kmeans
    df = _points(spark, np.random.default_rng(0).normal(size=(400, 2)))
    drawn = draw_batches(df, 8, 20, 42)
    assert drawn.groupBy("step").count().count() == 20 and 600 < drawn.count() < 1400
    assert drawn.select("row_id", "step").distinct().count() == drawn.count()
    assert minibatch_kmeans(df, 5, batch_size=50, max_iter=8).select("cluster").distinct().count() == 5
