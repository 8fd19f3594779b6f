"""External metrics: golden published contingency + independent numpy formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from golden_cells import CELLS
from taxolens.operators.metrics import contingency, experiment_row, external_metrics


def _np_metrics(truth, pred):
    """Independent textbook implementations over label arrays."""
    t_vals, t = np.unique(truth, return_inverse=True)
    p_vals, p = np.unique(pred, return_inverse=True)
    C = np.zeros((len(t_vals), len(p_vals)))
    np.add.at(C, (t, p), 1)
    n = C.sum()
    purity = C.max(axis=0).sum() / n
    a, b = C.sum(1), C.sum(0)
    comb = lambda x: x * (x - 1) / 2
    idx = comb(C).sum()
    exp = comb(a).sum() * comb(b).sum() / comb(n)
    mx = (comb(a).sum() + comb(b).sum()) / 2
    ari = 1.0 if mx == exp else (idx - exp) / (mx - exp)
    pij = C / n
    nz = pij > 0
    mi = (pij[nz] * np.log(pij[nz] / np.outer(a / n, b / n)[nz])).sum()
    ha = -(a / n * np.log(a / n)).sum()
    hb = -(b / n * np.log(b / n)).sum()
    nmi = mi / ((ha + hb) / 2) if mi > 0 else 0.0
    tk = (C ** 2).sum() - n
    fmi = tk / math.sqrt(((b ** 2).sum() - n) * ((a ** 2).sum() - n)) if tk else 0.0
    return dict(purity=purity, ari=ari, nmi=nmi, homogeneity=mi / ha if ha else 1.0,
                completeness=mi / hb if hb else 1.0, fowlkes_mallows=fmi)


def test_golden_contingency(spark):
    cont = spark.createDataFrame(CELLS, "cluster int, true_label string, n long")
    m = external_metrics(cont, ["purity", "nmi", "ari"]).first()
    assert m["purity"] == pytest.approx(0.8981481481, abs=1e-9)
    assert m["nmi"] == pytest.approx(0.8591196419, abs=1e-9)
    assert m["ari"] == pytest.approx(0.5997543239, abs=1e-9)
    per_cluster = cont.groupBy("cluster").count().agg(F.avg("count")).first()[0]
    assert per_cluster == pytest.approx(1.1842105263, abs=1e-9)
    assert cont.agg(F.sum("n")).first()[0] == 4536


def test_golden_experiment_row(spark):
    rows = [(i, c, l) for i, (c, l, n) in enumerate((c, l, n) for c, l, n in CELLS for _ in range(n))]
    df = spark.createDataFrame(rows, "row_id long, cluster int, true_label string")
    r = experiment_row(df).first()
    assert r["num_L3"] == 34 and r["num_clusters"] == 76
    assert r["accuracy_pct"] == pytest.approx(89.81481481, abs=1e-6)
    assert r["coverage"] == 1.0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_metrics_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 5, 300)
    pred = np.where(rng.random(300) < 0.6, truth, rng.integers(-1, 7, 300))
    df = spark.createDataFrame([(i, f"t{t}", int(p)) for i, (t, p) in enumerate(zip(truth, pred))],
                               "row_id long, true_label string, cluster int")
    got = external_metrics(contingency(df)).first().asDict()
    exp = _np_metrics(np.array([f"t{t}" for t in truth]), pred)
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    assert got["v_measure"] == pytest.approx(got["nmi"], abs=1e-9)


def test_perfect_and_permuted(spark):
    rows = [(i, f"c{i % 4}", (i % 4) * 7) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, true_label string, cluster int")
    m = external_metrics(contingency(df)).first()
    for k in ["purity", "ari", "nmi", "homogeneity", "completeness", "v_measure", "fowlkes_mallows"]:
        assert m[k] == pytest.approx(1.0)


def test_null_truth_dropped_noise_kept(spark):
    df = spark.createDataFrame([(0, "a", 0), (1, None, 0), (2, "b", -1), (3, "b", -1)],
                               "row_id long, true_label string, cluster int")
    cells = {(r["true_label"], r["cluster"]): r["n"] for r in contingency(df).collect()}
    assert cells == {("a", 0): 1, ("b", -1): 2}


def test_moments_far_from_the_origin(spark):
    import numpy as np

    from taxolens.operators.vectors import calinski_harabasz, davies_bouldin
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 300)
    X = rng.normal(size=(300, 5)) + y[:, None] + 1e6
    df = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(X, y))],
                               "row_id long, features array<double>, cluster int").repartition(5)
    mean = np.array([X[y == c].mean(0) for c in range(4)])
    ssw = sum(((X[y == c] - mean[c]) ** 2).sum() for c in range(4))
    ssb = sum((y == c).sum() * ((mean[c] - X.mean(0)) ** 2).sum() for c in range(4))
    s = np.array([np.sqrt(((X[y == c] - mean[c]) ** 2).sum(1)).mean() for c in range(4)])
    gap = np.sqrt(((mean[:, None] - mean) ** 2).sum(-1)) + np.diag([np.inf] * 4)
    assert np.isclose(calinski_harabasz(df).first()[0], ssb / 3 / (ssw / 296), rtol=1e-6)
    assert np.isclose(davies_bouldin(df).first()[0], ((s[:, None] + s) / gap).max(1).mean(), rtol=1e-6)
    same = df.selectExpr("row_id", "transform(features, x -> double(cluster)) AS features", "cluster")
    assert calinski_harabasz(same).first()[0] == 1.0
