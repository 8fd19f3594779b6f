"""C8 BIRCH: clustering-feature (CF) summaries that do not depend on partitions.

A CF is (n, LS, SS) with the least row id it holds; radius = sqrt(SS/n − ‖LS/n‖²). Equal vectors are one entry from the
start. Entries are dealt to Voronoi cells of seeds, which are entries drawn by the hash of their id, about one for
``CELL_ROWS`` entries: their number grows with the data, and dense regions get more of them. Seeds have two levels, so
that an entry meets about √m top seeds (broadcast) and then only the seeds of its top cell; top cells are split by a salt,
so that none is a single task.

Within a cell, the first entry without a CF (by hash of its id) leads: entries in the order of their distance to it join
as long as the radius stays ≤ threshold, by running sums. ``merge_rounds`` repeats that with other seeds over the CFs, so
that CFs at the borders of cells combine. Optional global step: Ward over the CF centroids to ``n_clusters`` (each
centroid counts once). Labels: nearest CF centroid (J7), numbered by the CF's least row id.
Invariants (tested): every CF radius ≤ threshold, Σ n = N, Σ LS and Σ SS are those of the rows; the same CFs for any number
of partitions. Labels are not identical to a sequential CF tree (which is order dependent).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.clustering.ward import ward_groups
from taxolens.operators.neighbors import dense_index, pair_distances, stack
from taxolens.operators.vectors import assign_nearest, nearest_join
from taxolens.schema import CLUSTER, ROW_ID, SEED
from taxolens.session import cut_lineage, cut_round

CF_SCHEMA = "first long, n double, ls array<double>, ss double"
#: Entries for which there is one seed, and entries that meet the seeds of their top cell in one task.
CELL_ROWS, SALT_ROWS = 4096, 65_536
#: Entries next to a leader that are ordered at first.
NEAR_ROWS = 32
#: Centroids that the driver collects to broadcast; as Python rows they take four times as much.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def cf_entries(df: DataFrame, features: str = "features") -> DataFrame:
    """One CF for each distinct vector."""
    n = F.col("n")
    sq = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    return (df.groupBy(F.col(features).cast("array<double>").alias("x"))
            .agg(F.min(ROW_ID).cast("long").alias("first"), F.count(F.lit(1)).cast("double").alias("n"))
            .select("first", "n", F.transform("x", lambda v: v * n).alias("ls"), (sq * n).alias("ss")))


def _drawn(entries: DataFrame, m: int, seed: int) -> DataFrame:
    """The m entries whose ids hash lowest."""
    return entries.orderBy(F.xxhash64("first", F.lit(seed)), "first").limit(m)


def _nearest(center: pd.Series, seeds: np.ndarray) -> np.ndarray:
    return pair_distances(stack(center), seeds).argmin(axis=1)


def cf_cells(entries: DataFrame, seed: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``entries`` with ``cell``, the id of the seed whose cell they are in."""
    n = entries.count()
    m = max(1, math.ceil(n / cell_rows))
    center = F.transform("ls", lambda v: v / F.col("n")).alias("center")
    seeds = cut_lineage(_drawn(entries, m, seed).select("first", center))
    tops = _drawn(seeds, math.ceil(math.sqrt(m)), seed + 1).orderBy("first").collect()
    # about the root of n / cell_rows vectors
    top = entries.sparkSession.sparkContext.broadcast(np.array([r["center"] for r in tops], dtype=np.float64))

    @F.pandas_udf("int")
    def top_of(c: pd.Series) -> pd.Series:
        return pd.Series(_nearest(c, top.value).astype(np.int32) if len(c) else [], dtype="int32")

    rows = cut_lineage(entries.select("*", center).withColumn("top", top_of("center")))
    salts = rows.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("salts"))
    salts = F.broadcast(salts)  # a row a top seed
    left = rows.join(salts, "top").withColumn("salt", F.pmod(F.xxhash64("first"), "salts"))
    right = (seeds.withColumn("top", top_of("center")).join(salts, "top")
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
             .select("top", "salt", F.col("first").alias("cell"), "center"))

    def deal(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = lp[["first", "n", "ls", "ss"]].copy()
        if len(lp) == 0:
            return out.assign(cell=pd.Series(dtype="int64"))
        rp = rp.sort_values("cell")
        # a top cell may have entries, but no seed nearest to its top seed
        own = lp["first"].to_numpy() * 0 + lp["top"].to_numpy() if rp.empty else rp["cell"].to_numpy()[
            _nearest(lp["center"], stack(rp["center"]))]
        return out.assign(cell=own)

    return (left.groupBy("top", "salt").cogroup(right.groupBy("top", "salt"))
            .applyInPandas(deal, CF_SCHEMA + ", cell long"))


def absorb(first: np.ndarray, n: np.ndarray, ls: np.ndarray, ss: np.ndarray, threshold: float):
    """CFs of the entries of one cell: leaders in order, each with the nearest entries that keep its radius."""
    center, left, out = ls / n[:, None], np.arange(len(n)), []
    while len(left):
        d = ((center[left] - center[left[0]]) ** 2).sum(axis=1)
        # most leaders end after a few entries: only the nearest are ordered, and more of them if none was too wide
        most = NEAR_ROWS
        while True:
            near = np.flatnonzero(d <= np.partition(d, most - 1)[most - 1]) if most < len(d) else np.arange(len(d))
            order = left[near[np.argsort(d[near], kind="stable")]]
            # the leader first, also among equal distances
            order = np.concatenate([left[:1], order[order != left[0]]])
            size, run_ls, run_ss = np.cumsum(n[order]), np.cumsum(ls[order], axis=0), np.cumsum(ss[order])
            wide = run_ss / size - ((run_ls / size[:, None]) ** 2).sum(axis=1) > threshold * threshold + 1e-12
            wide[0] = False
            if wide.any() or len(near) == len(d):
                break
            most *= 8
        k = int(wide.argmax()) if wide.any() else len(order)
        own = order[:k]
        out.append((int(first[own].min()), float(size[k - 1]), run_ls[k - 1].tolist(), float(run_ss[k - 1])))
        left = left[~np.isin(left, own)]
    return out


def cf_round(entries: DataFrame, threshold: float, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One round of absorption over CFs ``(first, n, ls, ss)``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "first"])
        got = absorb(pdf["first"].to_numpy(), pdf["n"].to_numpy(float), stack(pdf["ls"]), pdf["ss"].to_numpy(float),
                     threshold)
        return pd.DataFrame(got, columns=["first", "n", "ls", "ss"])

    cells = cf_cells(entries, seed, cell_rows).withColumn("_h", F.xxhash64("first", F.lit(seed)))
    return cut_round(cells.groupBy("cell").applyInPandas(run, CF_SCHEMA))


def cf_build(df: DataFrame, threshold: float, features: str = "features", merge_rounds: int = 1,
             cell_rows: int = CELL_ROWS) -> DataFrame:
    """CFs of the rows, ``merge_rounds`` times merged."""
    cfs = cut_lineage(cf_entries(df, features))
    for k in range(merge_rounds + 1):
        cfs = cf_round(cfs, threshold, SEED + 2 * k, cell_rows)
    return cfs


def birch(df: DataFrame, threshold: float = 0.5, n_clusters: int | None = 50, features: str = "features",
          merge_rounds: int = 1, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Labeling by nearest CF (``n_clusters=None``) or by Ward groups of CFs."""
    data = df.select(ROW_ID, features)
    cfs = cf_build(data, threshold, features, merge_rounds, cell_rows)
    cents = cfs.join(dense_index(cfs, "first", "cid"), "first").select(
        "cid", F.transform("ls", lambda v: v / F.col("n")).alias("centroid"))
    return label_rows(data, cut_lineage(cents), n_clusters, features)


def label_rows(data: DataFrame, cents: DataFrame, n_clusters: int | None, features: str = "features") -> DataFrame:
    """Label of the nearest centroid ``(cid, centroid)``, or of its Ward group if there are more than ``n_clusters``."""
    size = cents.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 <= BROADCAST_LIMIT_BYTES:
        rows = cents.orderBy("cid").collect()
        labels = assign_nearest(data, np.array([r["centroid"] for r in rows], dtype=np.float64),
                                np.array([r["cid"] for r in rows]), features, dist_col=None).select(ROW_ID, CLUSTER)
    else:  # too many centroids for the driver: blocked nearest join
        labels = nearest_join(data, cents, features).select(ROW_ID, CLUSTER)
    if n_clusters is None or n_clusters >= size["n"]:
        return labels
    groups = ward_groups(cents.select(F.col("cid").alias("id"), F.lit(1.0).alias("n"), F.col("centroid").alias("mean")),
                         n_clusters)
    return labels.join(groups, labels[CLUSTER] == groups["id"]).select(ROW_ID, F.col("grp").alias(CLUSTER))


def cf_radius(cfs: DataFrame) -> DataFrame:
    """Per-CF radius (for the threshold invariant)."""
    sq = F.aggregate(F.col("ls"), F.lit(0.0), lambda acc, x: acc + x * x)
    return cfs.select("n", F.sqrt(F.greatest(F.col("ss") / F.col("n") - sq / (F.col("n") * F.col("n")),
                                            F.lit(0.0))).alias("radius"))
