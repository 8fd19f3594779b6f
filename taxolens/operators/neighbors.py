"""Blocked all-pairs computation and iterative connected components.

``block_cogroup`` is the primitive behind every O(N²) operator (silhouette,
eps-neighbourhoods, centroid-pair distances): rows are hashed into ``nb``
blocks, each (left block, right block) pair becomes one cogroup key, and a
numpy kernel sees at most ``block_rows × block_rows`` pairs. Each row is
replicated ``nb`` times, so work per task is bounded no matter how the data
is skewed across clusters; kernels emit per-row aggregates, never pair lists.

Within a block, kernels go by tiles of ``TILE_ROWS`` a side. The squared distances
of a tile come from one matrix product, whose error is bounded (``SquaredTiles``);
whatever that error could decide is taken from the exact differences again, so the
results are those of ``pair_distances``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.schema import ROW_ID
from taxolens.session import cut_lineage, cut_round


#: Rows a side of a block that a task holds, values in its vectors, and rows a side of a tile that is evaluated at once.
BLOCK_ROWS, BLOCK_VALUES, TILE_ROWS = 32_768, 1 << 21, 512
#: Rows a side for which another task pays, and exact pairs that are evaluated at once.
LEAST_ROWS, EXACT_VALUES = 1024, 1 << 20
#: Pairs of blocks that have a partition of their own.
MOST_PAIRS = 4096
#: Edges whose components one task finds.
JOINED_EDGES = 1 << 14


def n_blocks_for(n_rows: int, block_rows: int) -> int:
    return max(1, math.ceil(n_rows / max(1, block_rows)))


def n_blocks(df: DataFrame, n_rows: int, features: str, block_rows: int | None = None) -> int:
    """Blocks a side for ``n_rows`` vectors: as few as fit a task (rows are copied to each), enough for all cores."""
    if block_rows is None:
        d = (df.filter(F.col(features).isNotNull()).select(F.size(features)).first() or [1])[0]
        block_rows = max(LEAST_ROWS, min(BLOCK_ROWS, BLOCK_VALUES // max(1, d)))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(n_blocks_for(n_rows, block_rows),
               min(math.ceil(math.sqrt(8 * cores)), n_blocks_for(n_rows, LEAST_ROWS)))


def block_cogroup(left: DataFrame, right: DataFrame, nb: int, kernel, schema: str,
                  key: str = ROW_ID, right_block=None) -> DataFrame:
    """Apply ``kernel(left_pdf, right_pdf)`` to every (left block, right block) pair.

    ``right_block`` is a column with the block of a right row, if that is not drawn by the hash of its key."""
    blk = lambda: F.pmod(F.xxhash64(F.col(key)), F.lit(nb)).cast("int")
    fan = F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    # fresh attribute ids on the right side so self-cogroups are unambiguous
    rb = right.withColumn("_rb", blk() if right_block is None else right_block).withColumn("_lb", fan)
    rb = rb.select(*[F.col(f"`{c}`").alias(c) for c in [*right.columns, "_rb", "_lb"]])
    lb = left.withColumn("_lb", blk()).withColumn("_rb", fan)

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({f.split()[0]: [] for f in schema.split(",")})
        return kernel(lp.drop(columns=["_lb", "_rb"]), rp.drop(columns=["_lb", "_rb"]))

    return lb.groupBy("_lb", "_rb").cogroup(rb.groupBy("_lb", "_rb")).applyInPandas(run, schema)


def _slots(spark, n: int) -> list[int]:
    """Longs that ``repartition(n, column)`` deals to partitions 0 to n - 1."""
    place = F.pmod(F.hash("id"), F.lit(n))
    found = {r["p"]: r["id"] for r in spark.range(16 * n).groupBy(place.alias("p")).agg(F.min("id").alias("id")).collect()}
    # one that was not found gets any other: its pairs share a partition
    return [found.get(k, k) for k in range(n)]


def block_pairs(df: DataFrame, nb: int, kernel, schema: str, key: str = ROW_ID) -> DataFrame:
    """Apply ``kernel(left_pdf, right_pdf)`` to every unordered pair of blocks; within a block right_pdf is None.

    For symmetric work: a row is sent ``nb`` times and a pair of rows meets once. Up to ``MOST_PAIRS`` pairs have a
    partition each, so that none waits for another."""
    spark, names = df.sparkSession, [f.split()[0] for f in schema.split(",")]
    pairs = [(i, j) for i in range(nb) for j in range(i, nb)]
    slots = _slots(spark, min(len(pairs), MOST_PAIRS))
    places = [(b, i, j, slots[k % len(slots)]) for k, (i, j) in enumerate(pairs) for b in {i, j}]
    places = F.broadcast(spark.createDataFrame(places, "_b int, _i int, _j int, _slot long"))
    rows = df.withColumn("_b", F.pmod(F.xxhash64(F.col(key)), F.lit(nb)).cast("int")).join(places, "_b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["_b"] == pdf["_i"]).to_numpy()
        same = bool(pdf["_i"].iloc[0] == pdf["_j"].iloc[0])
        pdf = pdf.drop(columns=["_b", "_i", "_j", "_slot"])
        if not same and (own.all() or not own.any()):
            return pd.DataFrame({n: [] for n in names})
        return kernel(pdf, None) if same else kernel(pdf[own], pdf[~own])

    return rows.repartition(len(slots), "_slot").groupBy("_slot", "_i", "_j").applyInPandas(run, schema)


def stack(series: pd.Series) -> np.ndarray:
    """pandas Series of arrays → 2-D float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances between the rows of a and b (chunked differences)."""
    out = np.empty((a.shape[0], b.shape[0]))
    step = max(1, int(2**22 // max(1, b.shape[0] * max(1, a.shape[1]))))
    for i in range(0, a.shape[0], step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def exact_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (a[i], b[j]), as ``pair_distances`` has them."""
    out = np.empty(len(i))
    step = max(1, EXACT_VALUES // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        d = a[i[at:at + step]] - b[j[at:at + step]]
        out[at:at + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


class SquaredTiles:
    """Squared distances of the rows of a and b by tiles, each from one matrix product.

    ``tol`` bounds their error: vectors are taken around the mean of b, and a sum of d + 2 products is off by at most d + 2
    roundings of the sum of their sizes. Data that are not finite have no bound; then the tiles are exact ones.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, rows: int = TILE_ROWS):
        self.a, self.b, self.rows = a, b, rows
        self.finite = bool(len(a) and len(b) and np.isfinite(a).all() and np.isfinite(b).all())
        self.tol = 0.0
        if self.finite:
            origin = b.mean(axis=0)
            x, y = a - origin, b - origin
            xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            self.finite = bool(np.isfinite(xx.max() + yy.max()))
            self.left = np.column_stack([-2.0 * x, xx, np.ones(len(x))])
            self.right = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), yy]).T)
            self.scale = float(xx.max() + yy.max())
            self.tol = 4.0 * (a.shape[1] + 8) * np.finfo(float).eps * self.scale

    def rows_of(self, n: int):
        return (slice(k, min(k + self.rows, n)) for k in range(0, n, self.rows))

    def tile(self, i: slice, j: slice) -> np.ndarray:
        if self.finite:
            return self.left[i] @ self.right[:, j]
        return pair_distances(self.a[i], self.b[j]) ** 2

    def exact(self, i: slice, j: slice, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return exact_distances(self.a[i], self.b[j], at, to)


def distance_tiles(a: np.ndarray, b: np.ndarray, upper: bool = False):
    """``(rows of a, rows of b, distances)`` by tiles. Those of (almost) equal vectors come from the differences.

    ``upper`` leaves out tiles below the diagonal, for b = a."""
    tiles = SquaredTiles(a, b)
    for i in tiles.rows_of(len(a)):
        for j in tiles.rows_of(len(b)):
            if upper and j.start < i.start:
                continue
            if not tiles.finite:
                yield i, j, pair_distances(a[i], b[j])
                continue
            D = tiles.tile(i, j)
            small = D <= tiles.scale * 1e-9
            np.sqrt(np.maximum(D, 0.0, out=D), out=D)
            if small.any():
                at, to = np.nonzero(small)
                D[at, to] = tiles.exact(i, j, at, to)
            yield i, j, D


def _boxes(X: np.ndarray, parts: list[slice]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([X[s].min(axis=0) for s in parts]), np.array([X[s].max(axis=0) for s in parts])


def near_tiles(a: np.ndarray, b: np.ndarray, eps: float, rows: int = TILE_ROWS):
    """``(places in a, places in b, whether their distance is ≤ eps)`` by tiles; tiles without such a pair may be left out.

    Both sides are ordered along the widest coordinate, and tiles whose boxes are farther apart than eps are skipped."""
    if not len(a) or not len(b) or not eps >= 0:
        return
    wide = int(np.nan_to_num(np.ptp(b, axis=0)).argmax()) if b.shape[1] else 0
    oa, ob = (np.argsort(x[:, wide], kind="stable") if x.shape[1] else np.arange(len(x)) for x in (a, b))
    tiles = SquaredTiles(a[oa], b[ob], rows)
    left, right = list(tiles.rows_of(len(a))), list(tiles.rows_of(len(b)))
    limit, tol = eps * eps, tiles.tol + 8.0 * np.finfo(float).eps * eps * eps
    (alo, ahi), (blo, bhi) = _boxes(tiles.a, left), _boxes(tiles.b, right)
    for k, i in enumerate(left):
        gap = np.maximum(0.0, np.maximum(alo[k] - bhi, blo - ahi[k]))
        # not by more than rounding, and never for data that are not finite
        far = np.einsum("ij,ij->i", gap, gap) > limit * (1 + 1e-9) + tol
        for m, j in enumerate(right):
            if far[m]:
                continue
            if not tiles.finite:
                yield oa[i], ob[j], pair_distances(tiles.a[i], tiles.b[j]) <= eps
                continue
            D = tiles.tile(i, j)
            ok, sure = D <= limit + tol, D <= limit - tol
            if np.count_nonzero(ok) != np.count_nonzero(sure):
                at, to = np.nonzero(ok ^ sure)
                ok[at, to] = tiles.exact(i, j, at, to) <= eps
            yield oa[i], ob[j], ok


def near_counts(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """For each row of a the number of rows of b at most eps away."""
    out = np.zeros(len(a), dtype=np.int64)
    for i, _, ok in near_tiles(a, b, eps):
        out[i] += np.count_nonzero(ok, axis=1)
    return out


def k_least(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k least distances of each row of a to rows of b (all, if b has fewer), ascending."""
    k = min(k, len(b))
    out = np.full((len(a), k), np.inf)
    tiles = SquaredTiles(a, b)
    for i in tiles.rows_of(len(a)):
        best = out[i]
        for j in tiles.rows_of(len(b)):
            if not tiles.finite:
                best = np.sort(np.concatenate([best, pair_distances(a[i], b[j])], axis=1), axis=1)[:, :k]
                continue
            D = tiles.tile(i, j)
            most = best[:, -1] ** 2
            if np.isinf(most).any() and D.shape[1] >= k:
                most = np.minimum(most, np.partition(D, k - 1, axis=1)[:, k - 1] + tiles.tol)
            at, to = np.nonzero(D <= (most * (1 + 1e-14) + tiles.tol)[:, None])
            d = tiles.exact(i, j, at, to)
            row, d = np.concatenate([np.repeat(np.arange(len(best)), k), at]), np.concatenate([best.ravel(), d])
            order = np.lexsort((d, row))
            row, d = row[order], d[order]
            first = np.searchsorted(row, np.arange(len(best)))
            best = d[first[:, None] + np.arange(k)]
        out[i] = best
    return out


def least_cost(a: np.ndarray, b: np.ndarray, ids: np.ndarray, own: np.ndarray | None = None,
               weights: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cost, id, distance)`` of the cheapest row of b for every row of a, of equal ones that of the least id.

    A cost is the squared distance, times v·w/(v + w) for ``weights`` v and w; ``own`` are the ids that rows of a skip."""
    cost, best = np.full(len(a), np.inf), np.full(len(a), np.iinfo(np.int64).max)
    dist = np.full(len(a), np.inf)
    tiles = SquaredTiles(a, b)
    for i in tiles.rows_of(len(a)):
        for j in tiles.rows_of(len(b)):
            D, W = tiles.tile(i, j), None
            slack = np.full(len(D), tiles.tol)
            if weights is not None:
                v, w = weights[0][i][:, None], weights[1][j][None, :]
                W = (v * w) / (v + w)
                D *= W
                slack *= W.max(axis=1)
            if own is not None:
                D[own[i][:, None] == ids[j][None, :]] = np.inf
            least = np.minimum(D.min(axis=1), cost[i])
            most = np.where(np.isfinite(least), least * (1 + 1e-14) + 2 * slack, -1.0)
            at, to = np.nonzero(D <= most[:, None])
            d = tiles.exact(i, j, at, to)
            c = d ** 2 if W is None else W[at, to] * d ** 2
            order = np.lexsort((ids[j][to], c, at))
            row, first = np.unique(at[order], return_index=True)
            c, d, other, row = c[order][first], d[order][first], ids[j][to][order][first], row + i.start
            new = (c < cost[row]) | ((c == cost[row]) & (other < best[row]))
            cost[row[new]], best[row[new]], dist[row[new]] = c[new], other[new], d[new]
    return cost, best, dist


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after the edges (a, b); ``labels`` are places of roots and their own roots, and stay so."""
    while True:
        x, y = labels[a], labels[b]
        if np.array_equal(x, y):
            return labels
        labels = labels.copy()
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def join_tile(labels: np.ndarray, left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """``labels`` after the edges between ``left`` and ``right`` where ok; only edges that join something are followed."""
    while True:
        rest = ok & (labels[left][:, None] != labels[right][None, :])
        rows, columns = np.flatnonzero(rest.any(axis=1)), np.flatnonzero(rest.any(axis=0))
        if not len(rows):
            return labels
        # an edge of every row and of every column
        labels = join_labels(labels, np.concatenate([left[rows], left[rest[:, columns].argmax(axis=0)]]),
                             np.concatenate([right[rest[rows].argmax(axis=1)], right[columns]]))


def _join_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """``(node, comp)`` of a few edges ``(a, b)``."""
    nodes, ends = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    return pd.DataFrame({"node": nodes, "comp": nodes[join_labels(np.arange(len(nodes)), ends[:, 0], ends[:, 1])]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Min-label connected components over an undirected edge list.

    A round points every node to its least neighbour, if that is less, follows the pointers by doubling, and
    contracts: edges between the roots are those of the next round. A root that nobody points to has a lesser
    neighbour in the next round, so two rounds at least halve the nodes that have edges, whatever the diameter.
    Few edges are joined in one task. Every step is a join or a ``groupBy(min)`` (partial aggregation, so a hub
    vertex does not land whole in one task); lineage is cut with reliable checkpoints. Returns ``(node, comp)``
    with ``comp = min node id`` of the component.
    """
    kind = dict(edges.dtypes)[src]
    schema = f"node {kind}, comp {kind}"
    # an end that is null joins nothing
    left = cut_lineage(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"))
                       .filter("a is not null").distinct())
    one = lambda few: few.groupBy().applyInPandas(_join_edges, schema)
    if left.count() <= JOINED_EDGES:
        return cut_lineage(one(left))
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node"))
    left = left.filter("a <> b")
    for _ in range(max_rounds):
        last = left.count() <= JOINED_EDGES
        if last:
            roots = one(left)
        else:
            ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("m")),
                                                 F.struct(F.col("b").alias("node"), F.col("a").alias("m")))).alias("e"))
            roots = cut_lineage(ends.groupBy("e.node").agg(F.min("e.m").alias("m"))
                                .select("node", F.least("node", "m").alias("comp")))
            while True:
                up = roots.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
                doubled = cut_round(roots.join(up, "comp").select("node", "comp", "up"))
                still = doubled.filter("up <> comp").limit(1).count()
                roots = doubled.select("node", F.col("up").alias("comp"))
                if not still:
                    break
        to = roots.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        labels = cut_round(labels.join(to, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        if last:
            return labels
        end = lambda c: roots.select(F.col("node").alias(c), F.col("comp").alias(f"r{c}"))
        left = cut_round(left.join(end("a"), "a").join(end("b"), "b").filter("ra <> rb")
                           .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    raise RuntimeError(f"components did not close in {max_rounds} rounds")


def grouped_block_cogroup(left: DataFrame, right: DataFrame, group: str, nb_col: str,
                          kernel, schema: str, key: str = ROW_ID) -> DataFrame:
    """Like ``block_cogroup`` but within groups: group g is split into ``nb_col``
    blocks per side (per-group, so only large groups pay replication)."""
    right = right.select(*[F.col(f"`{c}`").alias(c) for c in right.columns])
    blk = F.pmod(F.xxhash64(F.col(key)), F.col(nb_col)).cast("int")
    fan = F.explode(F.sequence(F.lit(0), F.col(nb_col) - 1))
    lb = left.withColumn("_lb", blk).withColumn("_rb", fan)
    rb = right.withColumn("_rb", blk).withColumn("_lb", fan)
    names = [f.split()[0] for f in schema.split(",")]

    def run(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({n: [] for n in names})
        return kernel(lp, rp)

    return (lb.groupBy(group, "_lb", "_rb").cogroup(rb.groupBy(group, "_lb", "_rb"))
            .applyInPandas(run, schema))


def local_components(ids: np.ndarray, adj: np.ndarray) -> np.ndarray:
    """Min-id labels of the components of a small dense graph (numpy, pointer jumping)."""
    n = len(ids)
    lab = np.arange(n)
    if n == 0:
        return ids
    big = n
    while True:
        nb_min = np.where(adj, lab[None, :], big).min(axis=1)
        new = np.minimum(lab, nb_min)
        new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    # translate index labels to min original id per component
    comp_min = {}
    for i, l in enumerate(lab):
        comp_min[l] = min(comp_min.get(l, ids[i]), ids[i])
    return np.array([comp_min[l] for l in lab], dtype=np.int64)


WINDOW_RANK_MAX = 200_000


def dense_index(df: DataFrame, col: str, out: str = "idx") -> DataFrame:
    """0-based dense rank of the distinct values of ``col`` (ascending).

    Distinct sets up to ``WINDOW_RANK_MAX`` values (counted first) are ranked
    with one ordered window; larger ones with sort + ``zipWithIndex``, which
    only counts partitions and never puts all values in one task.
    """
    distinct = df.select(col).distinct()
    n = distinct.count()
    if n <= WINDOW_RANK_MAX:
        from pyspark.sql import Window
        return distinct.select(col, (F.row_number().over(Window.orderBy(col)) - 1).cast("long").alias(out))
    ordered = distinct.orderBy(col)
    spark = df.sparkSession
    rdd = ordered.rdd.zipWithIndex().map(lambda t: (t[0][0], int(t[1])))
    return spark.createDataFrame(rdd, schema=f"{col} {dict(ordered.dtypes)[col]}, {out} long")
