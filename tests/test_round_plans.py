"""The driver's plans of loops stay small."""

import re

import numpy as np

from taxolens.operators.clustering import birch as B
from taxolens.operators.clustering import ward as W
from taxolens.session import cut_round


def _estimate(df, capsys):
    capsys.readouterr()
    df.explain(mode="cost")
    return max(re.findall(r"sizeInBytes=[\d.E+]+ (\w+)", capsys.readouterr().out), key=["B", "KiB", "MiB", "GiB", "TiB", "PiB",
                                                                                      "EiB"].index)


def test_size_estimates_do_not_grow_by_rounds(spark, capsys):
    state = spark.range(50).selectExpr("id", "id % 7 as v")
    for _ in range(5):
        state = cut_round(state.join(state.withColumnRenamed("v", "w"), "id").selectExpr("id", "(v + w) % 7 as v"))
    assert state.count() == 50 and _estimate(state, capsys) in ("B", "KiB")


def test_ward_rounds_have_small_plans(spark, monkeypatch, capsys):
    X = np.random.default_rng(6).normal(size=(80, 3))
    s = spark.createDataFrame([(i, 1.0, x.tolist()) for i, x in enumerate(X)], "id long, n double, mean array<double>")
    sizes, near = [], W._with_neighbours
    monkeypatch.setattr(W, "_with_neighbours", lambda a, *rest: sizes.append(_estimate(a, capsys)) or near(a, *rest))
    assert W.ward_groups(s, 3, block_rows=16).select("grp").distinct().count() == 3
    assert len(sizes) > 2 and set(sizes[1:]) <= {"B", "KiB"}


def test_labels_are_the_same_without_the_driver(spark, monkeypatch):
    X = np.random.default_rng(7).normal(size=(200, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>").cache()
    cents = spark.createDataFrame([(i, X[5 * i].tolist()) for i in range(30)], "cid long, centroid array<double>").cache()
    here = sorted(map(tuple, B.label_rows(df, cents, 6).collect()))
    monkeypatch.setattr(B, "BROADCAST_LIMIT_BYTES", 64)
    assert sorted(map(tuple, B.label_rows(df, cents, 6).collect())) == here
