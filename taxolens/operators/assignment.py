"""Maximum-weight assignment (Hungarian / shortest augmenting path) on a small dense matrix.

Used only on per-component overlap summaries built by Spark (E4).
"""

from __future__ import annotations

import numpy as np


def min_cost_assignment(cost: np.ndarray) -> np.ndarray:
    """Rectangular (n ≤ m) minimum-cost assignment; returns column for each row.

    Jonker–Volgenant style shortest augmenting paths with potentials, O(n²m).
    Ties resolve to the lowest column index.
    """
    cost = np.asarray(cost, dtype=np.float64)
    n, m = cost.shape
    if n > m:
        raise ValueError("rows must not exceed columns")
    u = np.zeros(n + 1)
    v = np.zeros(m + 1)
    p = np.zeros(m + 1, dtype=np.int64)  # p[j]: row (1-based) matched to column j
    way = np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        p[0] = i
        j0 = 0
        minv = np.full(m + 1, np.inf)
        used = np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            cur = cost[i0 - 1, :] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (cur < minv[1:])
            minv[1:][better] = cur[better]
            way[1:][better] = j0
            cand = np.where(free, minv[1:], np.inf)
            j1 = int(np.argmin(cand)) + 1
            delta = cand[j1 - 1]
            used_idx = np.nonzero(used)[0]
            u[p[used_idx]] += delta
            v[used_idx] -= delta
            minv[1:][free] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while True:
            j1 = way[j0]
            p[j0] = p[j1]
            j0 = j1
            if j0 == 0:
                break
    out = np.full(n, -1, dtype=np.int64)
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def max_weight_matching(weights: np.ndarray) -> np.ndarray:
    """Row → column maximising total weight (square or wide matrices)."""
    w = np.asarray(weights, dtype=np.float64)
    if w.shape[0] <= w.shape[1]:
        return min_cost_assignment(w.max(initial=0.0) - w)
    cols = min_cost_assignment((w.max(initial=0.0) - w).T)
    out = np.full(w.shape[0], -1, dtype=np.int64)
    out[cols] = np.arange(w.shape[1])
    return out
