"""What the end-to-end run does beside its rows' own work."""

import numpy as np
import pytest

from taxolens.functions import text
from taxolens.operators import vectors as V
from taxolens.operators.clustering import bisecting as B
from taxolens.plans import workflow


def test_names_of_characters_are_one_literal(spark, monkeypatch):
    sizes, create_map = [], text.F.create_map
    monkeypatch.setattr(text.F, "create_map", lambda *c: sizes.append(len(c)) or create_map(*c))
    rows = spark.createDataFrame([("&amp;&lt &nosuch; &ngE; &hearts;&AMPx &NewLine;",)], "t string")
    assert rows.select(text.decode_entities("t")).first()[0] == "&< &nosuch; ≧̸ ♥&x \n"
    assert max(sizes) < 100


def test_sums_of_leaves_take_one_pass(spark):
    X = np.random.default_rng(2).normal(size=(200, 3))
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>").cache()
    data.count()
    sc = spark.sparkContext
    sc.setJobGroup("sums", "sums")
    try:
        leaf = B._sums(data, B.Tree(), "features", {B.ROOT: X[0]})[B.ROOT]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("sums")) <= 2
    assert leaf.n == 200 and np.allclose(leaf.mean, X.mean(0))
    assert leaf.inertia == pytest.approx(((X - X.mean(0)) ** 2).sum())


def test_run_deals_rows_to_all_cores(spark, monkeypatch):
    class Stop(Exception):
        pass

    def stop(feats, *_, **__):
        raise Stop(feats.rdd.getNumPartitions())

    monkeypatch.setattr(workflow, "embed_text", stop)
    rows = spark.createDataFrame([(k, "words here", "a") for k in range(50)], "row_id long, Title string, true_label string")
    with pytest.raises(Stop) as stopped:
        workflow.run_analysis(rows.coalesce(1))
    assert stopped.value.args[0] >= spark.sparkContext.defaultParallelism


def test_labelings_of_a_run_share_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    X, y = rng.normal(size=(60, 4)), rng.integers(0, 3, (3, 60))
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>").cache()
    labs = [spark.createDataFrame([(i, int(c)) for i, c in enumerate(one)], "row_id long, cluster int").cache() for one in y]
    passes, pairs = [], V.block_pairs
    monkeypatch.setattr(V, "block_pairs", lambda *a, **k: passes.append(1) or pairs(*a, **k))
    got = workflow.shared_silhouettes(vecs, labs).first()
    assert len(passes) == 1
    for score, labels in zip(got, labs):
        assert score == pytest.approx(V.silhouette(vecs.join(labels, "row_id")).first()[0], abs=1e-12)
    assert workflow.shared_silhouettes(vecs.unionByName(vecs), labs) is None
