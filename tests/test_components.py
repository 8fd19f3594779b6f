"""Connected components in few rounds, whatever the diameter."""

import numpy as np
import pytest

from taxolens.operators import neighbors as N


@pytest.mark.parametrize("limit", [16, 1 << 14])
@pytest.mark.parametrize("shape", ["path", "mixed path", "star", "trees"])
def test_components_close_in_few_rounds(spark, monkeypatch, limit, shape):
    monkeypatch.setattr(N, "JOINED_EDGES", limit)
    rng, n = np.random.default_rng(2), 500
    at = rng.permutation(n) if shape == "mixed path" else np.arange(n)
    edges = {"path": [(at[i], at[i + 1]) for i in range(n - 1)], "mixed path": [(at[i], at[i + 1]) for i in range(n - 1)],
             "star": [(i, n) for i in range(n)],
             "trees": [(i, i - 5 * int(rng.integers(1, 4))) for i in range(15, n)] + [(3, 3), (1, 6)]}[shape]
    edges = [(int(a), int(b)) for a, b in edges]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges + [(None, edges[0][1])], "src long, dst long")
    got = dict(N.connected_components(df, max_rounds=12).filter("node is not null").collect())
    assert got == {x: find(x) for x in root}
