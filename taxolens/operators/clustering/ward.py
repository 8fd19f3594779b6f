"""C6 Ward linkage over (size, mean) summaries, as rounds of merges of reciprocal nearest neighbours.

Merging A and B costs Δ = n_A·n_B/(n_A+n_B)·‖μ_A − μ_B‖². Ward linkage is reducible: a merge brings no cluster nearer
to another than the nearer of its parts was. So two clusters that are each other's nearest are merged by the greedy order
as well, and a round merges all such pairs at once; clusters whose neighbour stays keep it, the others and the new ones
look for theirs again. Δ only rises along the tree, so the greedy cut at k clusters takes the N − k cheapest merges, and
the rounds end as soon as these are known: once N − k merges cost less than the nearest neighbours that are left.

Neighbours come from blocked cogroups (dirty clusters × all), so no task holds more than ``block_rows`` clusters a side
and the driver holds counts only. Once the clusters fit into one block, one task merges the rest in the greedy order. Equal costs go by the lower, then the higher id. Exact for Ward on the underlying rows
if every summary is a single row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.neighbors import (block_cogroup, connected_components, dense_index, least_cost,
                                          n_blocks, pair_distances, stack)
from taxolens.schema import CLUSTER, ROW_ID, SEED
from taxolens.session import cut_lineage, cut_round

_NEAREST = f"{ROW_ID} long, d double, other long"


def _nearest_kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Nearest other cluster of every left one; of equal ones the least id."""
    ids = left[ROW_ID].to_numpy()
    best, other, _ = least_cost(stack(left["mean"]), stack(right["mean"]), right[ROW_ID].to_numpy(), ids,
                                (left["n"].to_numpy(float), right["n"].to_numpy(float)))
    ok = np.isfinite(best)
    return pd.DataFrame({ROW_ID: ids[ok], "d": best[ok], "other": other[ok]})


def _with_neighbours(active: DataFrame, n_active: int, block_rows: int) -> DataFrame:
    """``active`` with ``nn`` and ``d`` of the clusters that lack them."""
    body = active.select(F.col("id").alias(ROW_ID), "n", "mean")
    found = block_cogroup(active.filter("nn is null").select(F.col("id").alias(ROW_ID), "n", "mean"), body,
                          n_blocks(body, n_active, "mean", None if block_rows >= 2048 else block_rows), _nearest_kernel,
                          _NEAREST)
    best = found.groupBy(ROW_ID).agg(F.min(F.struct("d", "other")).alias("b"))
    return cut_round(active.join(best, active["id"] == best[ROW_ID], "left").select(
        "id", "n", "mean", "h", F.coalesce("nn", "b.other").alias("nn"), F.coalesce("d", "b.d").alias("d")))


def _finish(step: int):
    """All merges of clusters that are one block, cheapest first."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, n, h = pdf["id"].to_numpy(), pdf["n"].to_numpy(float), pdf["h"].to_numpy(float)
        mean, m, out = stack(pdf["mean"]), len(pdf), []
        alive = np.ones(m, bool)
        cost = (n[:, None] * n) / (n[:, None] + n) * pair_distances(mean, mean) ** 2
        cost[np.tril_indices(m)] = np.inf
        least = cost.min(axis=1)
        for k in range(m - 1):
            i = int(least.argmin())
            j = int(cost[i].argmin())
            h[i] = max(cost[i, j], h[i], h[j])
            out.append((ids[i], ids[j], h[i], step + k))
            size = n[i] + n[j]
            mean[i] = (n[i] * mean[i] + n[j] * mean[j]) / size
            n[i] = size
            fresh = n * size / (n + size) * ((mean - mean[i]) ** 2).sum(axis=1)
            alive[j] = False
            # rows whose least entry may have changed: those that had it at i or j, and i
            stale = np.flatnonzero((cost[:, i] == least) | (cost[:, j] == least))
            cost[j], cost[:, j] = np.inf, np.inf
            cost[i, i + 1:] = np.where(alive[i + 1:], fresh[i + 1:], np.inf)
            cost[:i, i] = np.where(alive[:i], fresh[:i], np.inf)
            least[:i] = np.minimum(least[:i], cost[:i, i])
            stale = np.append(stale, [i, j])
            least[stale] = cost[stale].min(axis=1)
        return pd.DataFrame(out, columns=["lo", "hi", "h", "step"])
    return run


def ward_merges(summaries: DataFrame, n_clusters: int = 1, block_rows: int = 2048) -> tuple[DataFrame, int]:
    """Merges ``(lo, hi, h, step)`` that hold the cheapest N − ``n_clusters``, and N.

    ``summaries`` are ``(id, n, mean)``; a merged cluster goes by its least id, ``h`` is the cost of the merge (never less
    than that of the merges below it).
    """
    spark = summaries.sparkSession
    active = cut_lineage(summaries.select(
        F.col("id").cast("long").alias("id"), F.col("n").cast("double").alias("n"), "mean", F.lit(0.0).alias("h"),
        F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d")))
    total = n_active = active.count()
    merges = spark.createDataFrame([], "lo long, hi long, h double, step int")
    step = 0
    while n_active > max(1, n_clusters):
        if n_active <= block_rows:
            rest = (active.select("id", "n", "mean", "h").groupBy((F.col("n") * 0).alias("all"))
                    .applyInPandas(_finish(step), "lo long, hi long, h double, step int"))
            return cut_lineage(merges.unionByName(rest)), total
        known = _with_neighbours(active, n_active, block_rows)
        least = known.agg(F.min("d").alias("d")).first()["d"]
        if merges.filter(F.col("h") < F.lit(least)).count() >= total - n_clusters:
            break
        other = known.select(*(F.col(c).alias(f"{c}2") for c in known.columns))
        pairs = cut_round(known.join(other, (F.col("nn") == F.col("id2")) & (F.col("nn2") == F.col("id")))
                            .filter("id < id2"))
        size = F.col("n") + F.col("n2")
        # two steps: in one, n inside of the lambda would be the new n
        made = (pairs.withColumn("m", F.zip_with("mean", "mean2", lambda x, y: (
                    F.col("n") * x + F.col("n2") * y) / size)).withColumn("top", F.greatest("d", "h", "h2"))
                .select("id", size.alias("n"), F.col("m").alias("mean"), F.col("top").alias("h"),
                        F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d")))
        gone = pairs.select(F.explode(F.array("id", "id2")).alias("g"))
        stays = known.join(gone, F.col("id") == F.col("g"), "left_anti")
        lost = gone.withColumn("lost", F.lit(True))
        stays = stays.join(lost, F.col("nn") == F.col("g"), "left").select(
            "id", "n", "mean", "h", F.when(F.col("lost").isNull(), F.col("nn")).alias("nn"),
            F.when(F.col("lost").isNull(), F.col("d")).alias("d"))
        active = cut_round(stays.unionByName(made))
        merges = cut_lineage(merges.unionByName(pairs.select(
            F.col("id").alias("lo"), F.col("id2").alias("hi"), F.greatest("d", "h", "h2").alias("h"),
            F.lit(step).alias("step"))))
        n_active, step = active.count(), step + 1
    return merges, total


def ward_groups(summaries: DataFrame, n_clusters: int, block_rows: int = 2048) -> DataFrame:
    """``(id, grp)``: Ward's cut of ``(id, n, mean)`` at ``n_clusters``, groups numbered by their least id."""
    merges, total = ward_merges(summaries, n_clusters, block_rows)
    order = dense_index(merges.select(F.struct("h", "step", "lo", "hi").alias("m")), "m", "place")
    taken = order.filter(F.col("place") < max(0, total - max(1, n_clusters)))
    own = summaries.select(F.col("id").cast("long").alias("src"), F.col("id").cast("long").alias("dst"))
    comps = connected_components(own.unionByName(taken.select(F.col("m.lo").alias("src"), F.col("m.hi").alias("dst"))))
    numbers = dense_index(comps, "comp", "grp")
    return comps.join(numbers, "comp").select(F.col("node").alias("id"), F.col("grp").cast("int").alias("grp"))


def ward_micro(df: DataFrame, n_clusters: int = 50, micro_clusters: int = 1000, features: str = "features",
               seed: int = SEED) -> DataFrame:
    """Micro-clusters by Spark k-means, Ward over their summaries, labels mapped back."""
    from taxolens.operators.clustering.kmeans import kmeans
    from taxolens.operators.vectors import centroids

    micro = kmeans(df, n_clusters=micro_clusters, n_init=1, seed=seed, features=features)
    lab = cut_lineage(df.select(ROW_ID, features).join(micro, ROW_ID))
    groups = ward_groups(centroids(lab, features).select(
        F.col("cluster").alias("id"), F.col("size").alias("n"), F.col("centroid").alias("mean")), n_clusters)
    # at most micro_clusters rows
    return lab.join(F.broadcast(groups), lab[CLUSTER] == groups["id"]).select(ROW_ID, F.col("grp").alias(CLUSTER))
