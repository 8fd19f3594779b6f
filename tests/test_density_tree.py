"""The spanning tree from forests of pairs of blocks."""

import numpy as np
import pytest

from taxolens.operators.clustering import density as D
from taxolens.operators.neighbors import pair_distances


def _kruskal(ids, M):
    lo, hi = np.triu_indices(len(ids), 1)
    order = np.lexsort((np.maximum(ids[lo], ids[hi]), np.minimum(ids[lo], ids[hi]), M[lo, hi]))
    root, out = list(range(len(ids))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in order:
        a, b = find(lo[k]), find(hi[k])
        if a != b:
            root[a] = b
            out.append((*sorted((int(ids[lo[k]]), int(ids[hi[k]]))), float(M[lo[k], hi[k]])))
    return sorted(out)


def _sets():
    rng = np.random.default_rng(8)
    twice = rng.normal(size=(90, 6))
    twice[30:60] = twice[:30]
    return [rng.normal(size=(160, 12)), np.round(rng.uniform(0, 2, (150, 2)), 1) + 100.0, twice]


@pytest.mark.parametrize("k", range(3))
def test_tree_equals_kruskal_in_one_pass_over_pairs(spark, monkeypatch, k):
    """Ties, repeated vectors, distances that differ by rounding only; rounds over edges until few are left."""
    monkeypatch.setattr(D, "LAST_EDGES", 40)
    passes, pairs = [], D.block_pairs
    monkeypatch.setattr(D, "block_pairs", lambda *a, **kw: passes.append(1) or pairs(*a, **kw))
    X = _sets()[k]
    ids = np.random.default_rng(k).permutation(len(X)) * 3
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, X)], "row_id long, features array<double>").cache()
    core = D.core_distances(df, 4, block_rows=40).cache()
    found = dict(core.collect())
    c = np.array([found[int(i)] for i in ids])
    M = np.maximum(pair_distances(X, X), np.maximum(c[:, None], c[None, :]))
    got = sorted((r["src"], r["dst"], r["w"]) for r in D.boruvka_mst(df, core, block_rows=40).collect())
    assert got == _kruskal(ids, M)
    assert len(passes) == 1
