"""T1/T2 grid search scored by silhouette on one persisted seeded sample."""

from __future__ import annotations

import itertools
import time

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolens.operators.clustering.registry import run_algorithm
from taxolens.operators.vectors import silhouette
from taxolens.schema import CLUSTER, NOISE, ROW_ID
from taxolens.sources.sampling import restrict_to, sample_ids

RESULT_SCHEMA = T.StructType([
    T.StructField("combo_idx", T.IntegerType()), T.StructField("params", T.StringType()),
    T.StructField("n_clusters", T.LongType()), T.StructField("silhouette", T.DoubleType()),
    T.StructField("time", T.DoubleType()), T.StructField("error", T.StringType())])

# The score of a labeling that cannot be scored, and the start of the search.
UNSCORED, START = -1.0, -2.0


def param_grid(grid: dict[str, list]) -> list[dict]:
    """Cartesian product in the grid's key order (itertools.product order)."""
    keys = list(grid)
    return [dict(zip(keys, v)) for v in itertools.product(*(grid[k] for k in keys))]


def _score(data: DataFrame, val: DataFrame, algo: str, params: dict, n: int, features: str) -> tuple[int, float]:
    """Clusters and silhouette of one parameter set (``UNSCORED`` with fewer than 2 or more than N-1 clusters)."""
    labels = run_algorithm(algo, data, **params).persist()
    try:
        k = labels.filter(F.col(CLUSTER) != NOISE).select(CLUSTER).distinct().count()
        if not 2 <= k <= n - 1:
            return k, UNSCORED
        value = silhouette(val.join(labels, ROW_ID), features).first()["silhouette"]
        return k, UNSCORED if value is None else float(value)
    finally:
        labels.unpersist()


def tune_hyperparameters(df: DataFrame, algo: str, grid: dict[str, list], sample_size: int | None = None,
                         features: str = "features", seed: int = 42):
    """Returns (best_params, best_score, results DataFrame): one row per parameter set, the first best one wins.

    Scores are of all rows unless ``sample_size`` asks for a seeded sample. A parameter set that the algorithm
    rejects has its message in ``error`` and no score; anything else, such as a lost executor, is raised.
    """
    spark: SparkSession = df.sparkSession
    data = df.select(ROW_ID, features).persist()
    try:
        n = data.count()
        val = data if sample_size is None else restrict_to(data, sample_ids(data, sample_size, seed=seed))
        rows = []
        for i, params in enumerate(param_grid(grid)):
            began = time.time()
            try:
                k, score = _score(data, val, algo, params, n, features)
                rows.append((i, str(params), int(k), score, time.time() - began, None))
            except (ValueError, TypeError, IllegalArgumentException) as e:
                rows.append((i, str(params), None, None, time.time() - began, str(e)[:500]))
    finally:
        data.unpersist()
    best_params, best_score = None, START
    for row, params in zip(rows, param_grid(grid)):
        if row[3] is not None and row[3] > best_score:
            best_params, best_score = params, row[3]
    return best_params, best_score, spark.createDataFrame(rows, RESULT_SCHEMA)


def best_of(results: DataFrame) -> DataFrame:
    """Highest silhouette, ties → first combination."""
    return results.orderBy(F.col("silhouette").desc(), F.col("combo_idx")).limit(1)


def require_params(best_params):
    """A clear error instead of unpacking None."""
    if best_params is None:
        raise RuntimeError("tuning produced no usable parameter combination")
    return best_params
