"""C4 DBSCAN (and the J6 ε-neighbourhood counts) as a distributed job.

1. Pivots (rows drawn by a seeded hash, at most four for ``block_rows`` rows; of the
   powers of four of that, the number with which a sample of rows meets the fewest
   copies and pairs, see ``n_pivots``) split space into cells in two levels: √m of them
   are top pivots (broadcast), each pivot belongs to its nearest top pivot, a row
   to the nearest pivot of its nearest top pivot. A row is copied to every top
   cell t with d(x,t) ≤ d(x,t_home) + 2ε, and there to every cell p with
   d(x,p) ≤ d(x,p_nearest) + 2ε. By the triangle inequality every ε-neighbour of a
   row homed in a cell is then present in it, so each pair is evaluated exactly
   once, in the home cell of its left row. A row meets the pivots of the top cells
   near it only; top cells are split by a salt.
2. Cells are cut into blocks of ≤ ``BLOCK_ROWS`` rows per side (per cell, so a
   cell holding a third of the data is split, not sent to one task). Without pivots
   that help there is one cell, cut into blocks as all pairs of rows are.
3. Pass 1 counts neighbours (self included) → core flags, by tiles of a block.
4. Pass 2 emits, per block, only a star forest of the block's core–core
   components and, for border rows, the local component of adjacent cores.
5. Global connected components (min-label propagation with pointer jumping),
   cluster numbers by smallest core row_id, borders take the lowest cluster.
Matches the reference library's labels exactly (cluster order and border rule).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators import neighbors
from taxolens.operators.neighbors import (connected_components, dense_index, grouped_block_cogroup, join_tile,
                                          n_blocks, near_counts, near_tiles, pair_distances, stack)
from taxolens.schema import ROW_ID, SEED
from taxolens.sources.sampling import sample_exact
from taxolens.session import cut_lineage

#: Rows that meet the pivots of their top cell in one task.
SALT_ROWS = 65_536
#: Rows that tell how well pivots prune, pivots that are tried on them, and pairs that take as long as copying a row.
TRIED_ROWS, TRIED_PIVOTS, COPY_PAIRS = 2048, 8192, 1000


def _top_cells(top, reach: float):
    """Nearest top pivot of a vector, and all that are at most ``reach`` farther."""
    @F.pandas_udf("struct<home:int, near:array<int>>")
    def assign(s: pd.Series) -> pd.DataFrame:
        if len(s) == 0:
            return pd.DataFrame({"home": pd.Series(dtype="int32"), "near": []})
        D = pair_distances(stack(s), top.value)
        ok = D <= D.min(axis=1)[:, None] + reach
        return pd.DataFrame({"home": D.argmin(axis=1).astype(np.int32),
                             "near": [np.flatnonzero(r).astype(np.int32).tolist() for r in ok]})
    return assign


def n_pivots(df: DataFrame, eps: float, features: str, block_rows: int, n_rows: int) -> tuple[int, float]:
    """How many pivots to take and how often rows are copied then, about; 1 if no number beats all pairs of rows.

    Only the plan depends on the rows that are tried, never the result."""
    most = max(1, -(-n_rows // max(1, block_rows)) * 4)
    pivots = stack(sample_exact(df.select(ROW_ID, features), min(most, TRIED_PIVOTS)).toPandas()[features])
    rows = stack(sample_exact(df.select(ROW_ID, features), TRIED_ROWS, seed=SEED + 1).toPandas()[features])
    best, m = (n_rows * n_rows + 0.0, 1, 1.0), most
    while m > 1 and len(rows):
        # more pivots than there are to try: their cells are as much narrower than those of the tried ones
        if m <= len(pivots):
            D = np.concatenate([pair_distances(rows[k:k + 256], pivots[:m]) for k in range(0, len(rows), 256)])
            home, near = D.argmin(axis=1), D <= D.min(axis=1)[:, None] + 2.0 * eps
            copies = float(near.sum()) / len(rows)
            pairs = float((np.bincount(home, minlength=m) * near.sum(axis=0)).sum()) * (n_rows / len(rows)) ** 2
            cost = pairs + n_rows * copies * COPY_PAIRS
            if cost < best[0]:
                best = (cost, m, copies)
        m //= 4
    return best[1], best[2]


def _cells(df: DataFrame, eps: float, features: str, block_rows: int, n_rows: int, m: int | None = None,
           copies: float = 1.0) -> DataFrame:
    """``row_id, features, home, cell``: a row for each cell that a row is copied to; cells are pivots' row ids.

    There are ``m`` pivots, four for ``block_rows`` rows if it is not given; a row has about that many ``copies``."""
    m = m or max(1, -(-n_rows // max(1, block_rows)) * 4)
    salt_rows = max(1, int(SALT_ROWS / max(1.0, copies)))
    pivots = cut_lineage(sample_exact(df.select(ROW_ID, features), m).select(F.col(ROW_ID).alias("pivot"),
                                                                             F.col(features).alias("at")))
    few = pivots.orderBy(F.xxhash64("pivot"), "pivot").limit(int(np.ceil(np.sqrt(m)))).collect()
    # about 2 √(n / block_rows) vectors
    top = df.sparkSession.sparkContext.broadcast(np.array([r["at"] for r in few], dtype=np.float64))
    near = (df.select(ROW_ID, features).withColumn("_t", _top_cells(top, 2.0 * eps)(F.col(features)))
            .select(ROW_ID, features, F.col("_t.home").alias("own"), F.explode("_t.near").alias("top")))
    near = cut_lineage(near)
    salts = near.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / salt_rows).alias("salts"))
    left = near.join(salts, "top").withColumn("salt", F.pmod(F.xxhash64(ROW_ID), "salts"))
    right = (pivots.withColumn("top", _top_cells(top, 0.0)(F.col("at"))["home"]).join(salts, "top")
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
             .select("top", "salt", "pivot", "at"))

    def deal(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({ROW_ID: [], features: [], "home": [], "cell": []})
        rp = rp.sort_values("pivot")
        D = pair_distances(stack(lp[features]), stack(rp["at"]))
        i, j = np.nonzero(D <= D.min(axis=1)[:, None] + 2.0 * eps)
        ids = rp["pivot"].to_numpy()
        # cells of other top cells are nobody's home here
        home = np.where(lp["own"].to_numpy() == lp["top"].to_numpy(), ids[D.argmin(axis=1)], np.iinfo(np.int64).min)
        return pd.DataFrame({ROW_ID: lp[ROW_ID].to_numpy()[i], features: lp[features].to_numpy()[i],
                             "home": home[i], "cell": ids[j]})

    return (left.groupBy("top", "salt").cogroup(right.groupBy("top", "salt"))
            .applyInPandas(deal, f"{ROW_ID} long, {features} array<double>, home long, cell long"))


def _prepared(df: DataFrame, eps: float, features: str, block_rows: int) -> DataFrame:
    """Cells with per-cell block counts, checkpointed.

    When pivots prune poorly (high dimension, eps near typical distances), every
    row goes to one cell, which is cut into as many blocks as all pairs of rows are.
    """
    df = cut_lineage(df.select(ROW_ID, features))
    n = df.count()
    m, copies = n_pivots(df, eps, features, block_rows, n)
    if m == 1:
        one = F.lit(0).cast("long")
        return df.select(ROW_ID, features, one.alias("home"), one.alias("cell"), F.lit(n_blocks(df, n, features)).alias("_nb"))
    return cut_lineage(_with_blocks(_cells(df, eps, features, block_rows, n, m, copies)))


def _with_blocks(rows: DataFrame) -> DataFrame:
    rows = cut_lineage(rows)
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_sz"))
    nb = sizes.select("cell", F.ceil(F.col("_sz") / neighbors.BLOCK_ROWS).cast("int").alias("_nb"))
    return rows.join(nb, "cell")


def _counted(rows: DataFrame, eps: float, features: str) -> DataFrame:
    """``(row_id, cnt)``: neighbours of every row in each block."""
    def kernel(lp, rp):
        return pd.DataFrame({ROW_ID: lp[ROW_ID].to_numpy(),
                             "cnt": near_counts(stack(lp[features]), stack(rp[features]), eps)})

    home = rows.filter(F.col("cell") == F.col("home"))
    return grouped_block_cogroup(home.select(ROW_ID, features, "cell", "_nb"),
                                 rows.select(ROW_ID, features, "cell", "_nb"),
                                 "cell", "_nb", kernel, f"{ROW_ID} long, cnt long")


def neighbor_counts(df: DataFrame, eps: float, features: str = "features",
                    block_rows: int = 2048) -> DataFrame:
    """``(row_id, n_neighbors)`` with the row itself counted, distance ≤ eps."""
    part = _counted(_prepared(df, eps, features, block_rows), eps, features)
    return part.groupBy(ROW_ID).agg(F.sum("cnt").alias("n_neighbors"))


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5, features: str = "features",
           block_rows: int = 2048) -> DataFrame:
    """C4: labeling ``(row_id, cluster)``; -1 = noise."""
    rows = _prepared(df, eps, features, block_rows)
    counts = _counted(rows, eps, features).groupBy(ROW_ID).agg((F.sum("cnt") >= min_samples).alias("core"))
    flagged = cut_lineage(rows.join(counts, ROW_ID))
    fhome = flagged.filter(F.col("cell") == F.col("home"))

    def link_kernel(lp, rp):
        lc, rc = lp["core"].to_numpy(bool), rp["core"].to_numpy(bool)
        left, right = stack(lp[features]), stack(rp[features])[rc]
        lid, rid = lp[ROW_ID].to_numpy(), rp[ROW_ID].to_numpy()[rc]
        # core–core components inside the block (union of both sides by id)
        ids, place = np.unique(np.concatenate([lid[lc], rid]), return_inverse=True)
        at, to = place[:lc.sum()], place[lc.sum():]
        labels = np.arange(len(ids))
        for i, j, ok in near_tiles(left[lc], right, eps):
            labels = join_tile(labels, at[i], to[j], ok)
        out = [pd.DataFrame({"a": ids, "b": ids[labels], "kind": 0})]
        # border candidates: non-core left rows adjacent to right cores, of which they have less than min_samples
        rest = lid[~lc]
        for i, j, ok in near_tiles(left[~lc], right, eps):
            row, hit = np.nonzero(ok)
            out.append(pd.DataFrame({"a": rest[i][row], "b": ids[labels[to[j][hit]]], "kind": 1}))
        return pd.concat(out, ignore_index=True).drop_duplicates().astype({"a": "int64", "b": "int64", "kind": "int32"})

    links = grouped_block_cogroup(fhome.select(ROW_ID, features, "core", "cell", "_nb"),
                                  flagged.select(ROW_ID, features, "core", "cell", "_nb"),
                                  "cell", "_nb", link_kernel, "a long, b long, kind int")
    links = cut_lineage(links.distinct())
    # a core row is in a star of every block: the stars' centers are joined, which are far fewer than the rows
    core_edges = links.filter(F.col("kind") == 0).select("a", "b")
    stars = cut_lineage(core_edges.groupBy("a").agg(F.min("b").alias("center")))
    centers = connected_components(core_edges.join(stars, "a").select(F.col("center").alias("src"), F.col("b").alias("dst"))
                                   .distinct())  # node → min core id of its component
    numbers = dense_index(centers, "comp", "cluster")
    numbered = centers.join(numbers, "comp").select("node", "cluster")
    core_lab = (stars.join(numbered, F.col("center") == F.col("node"))
                .select(F.col("a").alias(ROW_ID), "cluster"))
    border = (links.filter(F.col("kind") == 1).join(numbered, F.col("b") == F.col("node"))
              .groupBy(F.col("a").alias(ROW_ID)).agg(F.min("cluster").alias("bcl")))
    out = (df.select(ROW_ID).join(core_lab, ROW_ID, "left").join(border, ROW_ID, "left")
           .select(ROW_ID, F.coalesce("cluster", "bcl", F.lit(-1)).cast("int").alias("cluster")))
    return out
