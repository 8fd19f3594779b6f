"""C5 density primitives and C7 density sweep.

* ``core_distances``: exact k-th nearest-neighbour distance (self included, as in
  DBSCAN's neighbourhood) by blocked cogroups that keep k candidates per block.
* ``mr_nearest``: each row's nearest neighbour under mutual reachability
  max(core_a, core_b, d(a, b)).
* ``boruvka_mst``: minimum spanning tree of the mutual-reachability graph. Every
  unordered pair of blocks has the spanning forest of the edges between them made in
  one task; an edge that is in no such forest closes a cycle of lighter ones, so the
  tree is that of the forests' edges. Borůvka rounds over these (a ``groupBy(component)``
  min, then distributed connected components) end in one task once few are left.
  Rows are compared in one pass over the pairs; ties broken by (weight, low id, high id).
* ``density_sweep``: for each eps the clusters of core points (core distance ≤ eps)
  joined by MST edges of weight ≤ eps — the same clusters as DBSCAN's core components
  at that eps; other rows are noise. One row per (eps, row).
The condensed-tree / excess-of-mass selection of full HDBSCAN is not built (it is a
sequential pass over all N−1 MST edges).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.neighbors import (SquaredTiles, block_cogroup, block_pairs, connected_components, dense_index,
                                          join_labels, k_least, n_blocks, stack)
from taxolens.schema import CLUSTER, ROW_ID
from taxolens.session import cut_lineage, cut_round


def core_distances(df: DataFrame, min_samples: int = 5, features: str = "features",
                   block_rows: int | None = None) -> DataFrame:
    """``(row_id, core_dist)``: distance to the min_samples-th nearest row, self included."""
    k = min_samples
    n = df.count()

    def kernel(lp, rp):
        best = k_least(stack(lp[features]), stack(rp[features]), k)
        return pd.DataFrame({ROW_ID: lp[ROW_ID].to_numpy(), "d": best.tolist()})

    base = df.select(ROW_ID, features)
    cand = block_cogroup(base, base, n_blocks(base, n, features, block_rows), kernel, f"{ROW_ID} long, d array<double>")
    merged = cand.groupBy(ROW_ID).agg(F.array_sort(F.flatten(F.collect_list("d"))).alias("d"))
    return merged.select(ROW_ID, F.element_at("d", k).alias("core_dist"))


#: Edges between components that one task joins.
LAST_EDGES = 1 << 16


def _mr_least(a, b, lcore, rcore, lcomp, rcomp, rid):
    """For each row of a the least mutual reachability to rows of b of other components, and the least id that has it."""
    tiles = SquaredTiles(a, b)
    # cores are distances of other rows too, which may be farther apart than those here
    slack = tiles.tol + 8 * np.finfo(float).eps * max(lcore.max(), rcore.max()) ** 2
    best, nbr = np.full(len(a), np.inf), np.full(len(a), np.iinfo(np.int64).max)
    for i in tiles.rows_of(len(a)):
        for j in tiles.rows_of(len(b)):
            M = np.maximum(tiles.tile(i, j), (lcore[i] ** 2)[:, None])
            np.maximum(M, (rcore[j] ** 2)[None, :], out=M)
            M[lcomp[i][:, None] == rcomp[j][None, :]] = np.inf
            least = np.minimum(M.min(axis=1), best[i] ** 2)
            at, to = np.nonzero(M <= np.where(np.isfinite(least), least + 2 * slack, -1.0)[:, None])
            w = np.maximum(tiles.exact(i, j, at, to), np.maximum(lcore[i][at], rcore[j][to]))
            # of equal ones the least id
            order = np.lexsort((rid[j][to], w, at))
            row, first = np.unique(at[order], return_index=True)
            w, other, row = w[order][first], rid[j][to][order][first], row + i.start
            new = (w < best[row]) | ((w == best[row]) & (other < nbr[row]))
            best[row[new]], nbr[row[new]] = w[new], other[new]
    return best, nbr


def _mr_kernel(features):
    def kernel(lp, rp):
        lid, rid, lcore, rcore, lcomp, rcomp = (
            p[c].to_numpy() for c in (ROW_ID, "core_dist", "comp") for p in (lp, rp))
        best, nbr = _mr_least(stack(lp[features]), stack(rp[features]), lcore, rcore, lcomp, rcomp, rid)
        ok = np.isfinite(best)
        return pd.DataFrame({ROW_ID: lid[ok], "comp": lcomp[ok], "nbr": nbr[ok], "w": best[ok]})
    return kernel


def _forest_kernel(features):
    """Spanning forest of the edges between two blocks, or within one, by Borůvka rounds.

    A row keeps its lightest edge to another component. It is looked for again only if its end has joined the row's
    own, and then only if it may be lighter than the lightest that is known for the component."""
    def kernel(lp: pd.DataFrame, rp: pd.DataFrame | None) -> pd.DataFrame:
        both = lp if rp is None else pd.concat([lp, rp], ignore_index=True)
        X, core, ids = stack(both[features]), both["core_dist"].to_numpy(), both[ROW_ID].to_numpy()
        nodes, node = np.unique(ids, return_inverse=True)
        split, n = len(lp), len(both)
        sides = [(slice(0, n), slice(0, n))] if rp is None else [(slice(0, split), slice(split, n)),
                                                                (slice(split, n), slice(0, split))]
        labels, w, nbr = np.arange(len(nodes)), np.full(n, np.inf), np.zeros(n, np.int64)
        need, out = np.ones(n, bool), []
        while labels.any():
            comp = labels[node]
            for own, other in sides:
                at = np.flatnonzero(need[own]) + own.start
                if len(at):
                    w[at], found = _mr_least(X[at], X[other], core[at], core[other], comp[at], comp[other], ids[other])
                    nbr[at] = np.searchsorted(nodes, np.where(np.isfinite(w[at]), found, nodes[0]))
            valid = np.flatnonzero(np.isfinite(w) & (labels[nbr] != comp))
            if not len(valid):
                break
            lo, hi = np.minimum(node, nbr)[valid], np.maximum(node, nbr)[valid]
            order = np.lexsort((hi, lo, w[valid], comp[valid]))
            first = order[np.unique(comp[valid][order], return_index=True)[1]]
            picked, one = np.unique(np.column_stack([lo[first], hi[first]]), axis=0, return_index=True)
            out.append(pd.DataFrame({"src": nodes[picked[:, 0]], "dst": nodes[picked[:, 1]], "w": w[valid][first][one]}))
            labels = join_labels(labels, picked[:, 0], picked[:, 1])
            comp = labels[node]
            known = np.isfinite(w) & (labels[nbr] != comp)
            least = np.full(len(nodes), np.inf)
            np.minimum.at(least, comp[known], w[known])
            need = ~known & np.isfinite(w) & (w <= least[comp])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"src": [], "dst": [], "w": []})
    return kernel


def _last_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning forest of the edges ``(src, dst, w, ca, cb)`` between components ca and cb."""
    pdf = pdf.sort_values(["w", "src", "dst"])
    comps, ends = np.unique(pdf[["ca", "cb"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    labels, left, taken = np.arange(len(comps)), np.arange(len(pdf)), []
    while True:
        a, b = labels[ends[left, 0]], labels[ends[left, 1]]
        left, a, b = (x[a != b] for x in (left, a, b))
        if not len(left):
            return pdf.iloc[np.sort(np.concatenate(taken))][["src", "dst", "w"]] if taken else pdf[["src", "dst", "w"]]
        least = np.full(len(comps), len(pdf))
        np.minimum.at(least, a, left)
        np.minimum.at(least, b, left)
        own = np.unique(least[least < len(pdf)])
        taken.append(own)
        labels = join_labels(labels, labels[ends[own, 0]], labels[ends[own, 1]])


def mr_nearest(df: DataFrame, core: DataFrame, features: str = "features",
               block_rows: int | None = None) -> DataFrame:
    """``(row_id, nbr, w)``: nearest other row under mutual reachability."""
    base = cut_lineage(df.select(ROW_ID, features).join(core, ROW_ID).withColumn("comp", F.col(ROW_ID)))
    n = base.count()
    cand = block_cogroup(base, base, n_blocks(base, n, features, block_rows), _mr_kernel(features),
                         f"{ROW_ID} long, comp long, nbr long, w double")
    best = cand.groupBy(ROW_ID).agg(F.min(F.struct("w", "nbr")).alias("b"))
    return best.select(ROW_ID, F.col("b.nbr").alias("nbr"), F.col("b.w").alias("w"))


def boruvka_mst(df: DataFrame, core: DataFrame, features: str = "features", block_rows: int | None = None,
                max_rounds: int = 64) -> DataFrame:
    """``(src, dst, w)`` minimum spanning tree edges of the mutual-reachability graph."""
    base = cut_lineage(df.select(ROW_ID, features).join(core, ROW_ID))
    n = base.count()
    if n <= 1:
        return None
    nb = n_blocks(base, n, features, block_rows)
    edges = cut_lineage(block_pairs(base, nb, _forest_kernel(features), "src long, dst long, w double")
                        .select("src", "dst", "w", F.col("src").alias("ca"), F.col("dst").alias("cb")))
    mst = edges.select("src", "dst", "w").limit(0)
    for _ in range(max_rounds):
        left = edges.count()
        if left <= LAST_EDGES:
            mst = cut_lineage(mst.unionByName(edges.groupBy().applyInPandas(_last_edges, "src long, dst long, w double")))
            break
        ends = edges.select(F.explode(F.array("ca", "cb")).alias("comp"), F.struct("w", "src", "dst", "ca", "cb").alias("e"))
        picked = cut_lineage(ends.groupBy("comp").agg(F.min("e").alias("e")).select("e.*").distinct())
        mst = cut_lineage(mst.unionByName(picked.select("src", "dst", "w")))
        # contract: every component with an edge has picked one; of parallel edges the least stays
        merged = connected_components(picked.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        a = merged.select(F.col("node").alias("ca"), F.col("comp").alias("na"))
        b = merged.select(F.col("node").alias("cb"), F.col("comp").alias("nb"))
        edges = cut_round(edges.join(a, "ca").join(b, "cb").filter("na <> nb")
                            .groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb"))
                            .agg(F.min(F.struct("w", "src", "dst")).alias("e")).select("e.*", "ca", "cb"))
    if mst.count() != base.select(ROW_ID).distinct().count() - 1:
        raise RuntimeError("the spanning tree did not close")
    return mst


def density_sweep(df: DataFrame, eps_list: list[float], min_samples: int = 5, features: str = "features",
                  block_rows: int | None = None) -> DataFrame:
    """``(eps, row_id, cluster)``; cluster numbers follow the smallest core row_id."""
    core = cut_lineage(core_distances(df, min_samples, features, block_rows))
    mst = boruvka_mst(df, core, features, block_rows)
    out = None
    for eps in eps_list:
        cores = core.filter(F.col("core_dist") <= eps).select(ROW_ID)
        e = mst.filter(F.col("w") <= eps).select("src", "dst") if mst is not None else None
        self_e = cores.select(F.col(ROW_ID).alias("src"), F.col(ROW_ID).alias("dst"))
        edges = self_e if e is None else self_e.unionByName(e)
        comps = connected_components(edges)
        num = dense_index(comps, "comp", "c")
        lab = comps.join(num, "comp").select(F.col("node").alias(ROW_ID), F.col("c").cast("int").alias(CLUSTER))
        one = (df.select(ROW_ID).join(lab, ROW_ID, "left")
               .select(F.lit(float(eps)).alias("eps"), ROW_ID, F.coalesce(CLUSTER, F.lit(-1)).alias(CLUSTER)))
        out = one if out is None else out.unionByName(one)
    return out
