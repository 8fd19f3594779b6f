"""C3 bisecting k-means with the leaf of most inertia split first.

The tree of splits is small (2k centres) and travels to the rows; a row's leaf is found by going down the tree, so no
labels are stored between the steps. The driver keeps, for every leaf, count, mean and inertia. Each step splits all
leaves that the order by inertia can reach next in the same passes over the rows; splits that turn out not to be needed
are left out at the end, so the result is that of one split after the other.

A split starts from the row farthest from the leaf's mean and the row farthest from that one (equal distances: least row
id), then moves the two centres to the means of their rows until they stand still or for ``max_iter`` passes. Leaves
whose rows are all equal are not split, so there are fewer than k clusters only if there are fewer distinct vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.neighbors import stack
from taxolens.schema import CLUSTER, ROW_ID

ROOT = 0


@dataclass
class Leaf:
    n: float
    mean: np.ndarray
    inertia: float


@dataclass
class Tree:
    """Splits ``node → (left, right)`` in the order they were made, centres and statistics of the nodes."""

    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    centers: dict[int, np.ndarray] = field(default_factory=dict)
    leaves: dict[int, Leaf] = field(default_factory=dict)

    def nodes_of(self, X: np.ndarray) -> np.ndarray:
        """The node without a split that each vector comes down to (equal distances: left)."""
        at = np.zeros(len(X), np.int64)
        for node, (left, right) in self.children.items():
            mine = np.flatnonzero(at == node)
            if len(mine):
                a, b = (((X[mine] - self.centers[c]) ** 2).sum(axis=1) for c in (left, right))
                at[mine] = np.where(a <= b, left, right)
        return at

    def most(self, nodes: list[int]) -> int | None:
        """The node of most inertia; of equal ones the older. None if no node can be split."""
        best = max(nodes, key=lambda i: (self.leaves[i].inertia, -i))
        return best if self.leaves[best].inertia > 0 else None

    def cut(self, k: int) -> tuple[list[int], int | None]:
        """The nodes after the splits for ``k`` clusters as far as they are known, and the node to be split next."""
        nodes = [ROOT]
        while len(nodes) < k:
            node = self.most(nodes)
            if node is None:
                return nodes, None
            if node not in self.children:
                return nodes, node
            nodes.remove(node)
            nodes += self.children[node]
        return nodes, None

    def pruned(self, k: int) -> tuple[Tree, list[int]]:
        """The tree of the splits for ``k`` clusters alone, and its leaves in order."""
        nodes = set(self.cut(k)[0])
        inner = {n: c for n, c in self.children.items() if n not in nodes and self._above(n, nodes)}
        return Tree(inner, self.centers, self.leaves), sorted(nodes)

    def _above(self, node: int, nodes: set[int]) -> bool:
        return any(c in nodes or (c in self.children and self._above(c, nodes)) for c in self.children[node])

    def largest_first(self, k: int) -> bool:
        """Whether every split is that of the leaf with most inertia (parts of a leaf have no more than the leaf)."""
        nodes = [ROOT]
        while len(nodes) < k and (node := self.most(nodes)) is not None:
            parts = self.children[node]
            if sum(self.leaves[c].inertia for c in parts) > self.leaves[node].inertia * (1 + 1e-9) or any(
                    self.leaves[i].inertia > self.leaves[node].inertia for i in nodes):
                return False
            nodes.remove(node)
            nodes += parts
        return len(nodes) == k


def _pass(data: DataFrame, tree: Tree, measure, schema: str, features: str) -> list:
    """``measure(node, X, ids)`` rows of every node of every task; a few for each."""
    sent = data.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            X, ids = stack(pdf[features]), pdf[ROW_ID].to_numpy()
            at = sent.value.nodes_of(X)
            rows = [r for node in np.unique(at).tolist() for r in measure(node, X[at == node], ids[at == node])]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return data.mapInPandas(run, schema)


def _sums(data: DataFrame, tree: Tree, features: str, around: dict[int, np.ndarray]) -> dict[int, Leaf]:
    """Statistics of the nodes without a split, summed around the given points."""
    def measure(node, X, ids):
        Y = X - around.get(node, 0.0)
        yield node, float(len(Y)), float((Y * Y).sum()), Y.sum(axis=0).tolist()

    parts = _pass(data, tree, measure, "node long, n double, ss double, s array<double>", features)
    # n, ss and s in one row of sums, so that the rows are read once
    sums = (parts.select("node", F.posexplode(F.concat(F.array("n", "ss"), "s")).alias("pos", "v"))
            .groupBy("node", "pos").agg(F.sum("v").alias("v")).collect())
    of: dict[int, dict[int, float]] = {}
    for r in sums:
        of.setdefault(r["node"], {})[r["pos"]] = r["v"]
    out = {}
    for i, got in of.items():
        n, ss, *rest = (got[k] for k in range(len(got)))
        s = np.array(rest)
        inertia = ss - float(s @ s) / n
        out[i] = Leaf(n, around.get(i, 0.0) + s / n, 0.0 if inertia <= 1e-12 * max(ss, 1e-300) else inertia)
    return out


def _farthest(data: DataFrame, tree: Tree, features: str, points: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each of the nodes the row farthest from its point."""
    def measure(node, X, ids):
        if node in points:
            d = ((X - points[node]) ** 2).sum(axis=1)
            j = np.lexsort((ids, -d))[0]
            yield node, float(d[j]), int(-ids[j]), X[j].tolist()

    parts = _pass(data, tree, measure, "node long, d double, neg long, x array<double>", features)
    got = parts.groupBy("node").agg(F.max(F.struct("d", "neg", "x")).alias("m")).select("node", "m.x").collect()
    return {r["node"]: np.array(r["x"]) for r in got}


def _split(data: DataFrame, tree: Tree, nodes: list[int], features: str, max_iter: int, tol: float) -> None:
    """Split nodes of the tree, all in the same passes."""
    first = _farthest(data, tree, features, {i: tree.leaves[i].mean for i in nodes})
    second = _farthest(data, tree, features, first)
    moving = {}
    for i in nodes:
        left = max(tree.centers, default=ROOT) + 1
        tree.children[i] = (left, left + 1)
        tree.centers[left], tree.centers[left + 1] = first[i], second[i]
        moving[i] = (left, left + 1)
    for _ in range(max_iter):
        stats = _sums(data, tree, features, tree.centers)
        still = []
        for i, pair in moving.items():
            # a part without rows keeps its centre
            step = [(c, stats[c].mean) for c in pair if c in stats]
            if max(float(((m - tree.centers[c]) ** 2).sum()) for c, m in step) <= tol * tol:
                still.append(i)
            else:
                tree.centers.update(step)
        for i in still:
            del moving[i]
        if not moving:
            break
    stats = _sums(data, tree, features, tree.centers)
    for i in nodes:
        for c in tree.children[i]:
            tree.leaves[c] = stats.get(c, Leaf(0, tree.centers[c], 0.0))


def bisecting_tree(df: DataFrame, n_clusters: int, features: str = "features", max_iter: int = 20,
                   tol: float = 1e-9) -> Tree:
    """The splits that a cut at ``n_clusters`` needs (and some that it may not need)."""
    data = df.select(ROW_ID, features).persist()
    try:
        tree = Tree()
        head = data.first()
        if head is None:
            return tree
        tree.leaves[ROOT] = _sums(data, tree, features, {ROOT: np.array(head[1], float)})[ROOT]
        while True:
            nodes, missing = tree.cut(n_clusters)
            if missing is None:
                return tree
            ready = sorted((i for i in nodes if i not in tree.children and tree.leaves[i].inertia > 0),
                           key=lambda i: (-tree.leaves[i].inertia, i))
            _split(data, tree, ready[:n_clusters - len(nodes)], features, max_iter, tol)
    finally:
        data.unpersist()


def bisecting_kmeans(df: DataFrame, n_clusters: int = 50, features: str = "features", max_iter: int = 20,
                     tol: float = 1e-9) -> DataFrame:
    """Labeling ``(row_id, cluster)`` with exactly ``n_clusters`` clusters, numbered in the order of the leaves."""
    tree = bisecting_tree(df, n_clusters, features, max_iter, tol)
    if not tree.leaves:
        return df.select(ROW_ID, F.lit(0).alias(CLUSTER))
    pruned, leaves = tree.pruned(n_clusters)
    sent = df.sparkSession.sparkContext.broadcast((pruned, np.array(leaves)))

    @F.pandas_udf("int")
    def label(s: pd.Series) -> pd.Series:
        tree, order = sent.value
        if len(s) == 0:
            return pd.Series(dtype="int32")
        return pd.Series(np.searchsorted(order, tree.nodes_of(stack(s))).astype(np.int32))

    return df.select(ROW_ID, label(features).alias(CLUSTER))
