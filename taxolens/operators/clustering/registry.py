"""Algorithm plug-in registry: name → fn(df, **params) -> labeling (row_id, cluster)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from taxolens.schema import CLUSTER, ROW_ID

ALGORITHMS: dict[str, Callable[..., DataFrame]] = {}


def algorithm(name: str):
    def deco(fn):
        ALGORITHMS[name] = fn
        return fn
    return deco


def run_algorithm(name: str, df: DataFrame, **params) -> DataFrame:
    if name not in ALGORITHMS:
        raise KeyError(f"unknown algorithm {name!r}; known: {sorted(ALGORITHMS)}")
    return ALGORITHMS[name](df, **params).select(ROW_ID, CLUSTER)


@algorithm("KMeans")
def _kmeans(df, n_clusters=50, **kw):
    from taxolens.operators.clustering.kmeans import kmeans
    return kmeans(df, n_clusters=n_clusters, **kw)


@algorithm("BisectingKMeans")
def _bisecting(df, n_clusters=50, **kw):
    from taxolens.operators.clustering.bisecting import bisecting_kmeans
    return bisecting_kmeans(df, n_clusters=n_clusters, **kw)


@algorithm("MiniBatchKMeans")
def _minibatch(df, n_clusters=100, batch_size=1024, **kw):
    from taxolens.operators.clustering.minibatch import minibatch_kmeans
    return minibatch_kmeans(df, n_clusters=n_clusters, batch_size=batch_size, **kw)


@algorithm("DBSCAN")
def _dbscan(df, eps=0.5, min_samples=5, **kw):
    from taxolens.operators.clustering.dbscan import dbscan
    return dbscan(df, eps=eps, min_samples=min_samples, **kw)


@algorithm("Lloyd")
def _lloyd(df, n_clusters=8, iterations=5, **kw):
    from taxolens.operators.vectors import lloyd_fixed
    return lloyd_fixed(df, n_clusters, iterations, **kw)


@algorithm("BIRCH")
def _birch(df, threshold=0.5, n_clusters=None, **kw):
    from taxolens.operators.clustering.birch import birch
    return birch(df, threshold=threshold, n_clusters=n_clusters, **kw)


@algorithm("Ward")
def _ward(df, n_clusters=50, micro_clusters=1000, **kw):
    from taxolens.operators.clustering.ward import ward_micro
    return ward_micro(df, n_clusters=n_clusters, micro_clusters=micro_clusters, **kw)


@algorithm("DensityCut")
def _density_cut(df, eps=0.5, min_samples=5, **kw):
    from taxolens.operators.clustering.density import density_sweep
    return density_sweep(df, [eps], min_samples, **kw)
