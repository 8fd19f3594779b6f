"""C1 k-means (n_init restarts) on Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.schema import CLUSTER, ROW_ID, SEED


#: Rows of a partition from which they are dealt to more cores.
PARTITION_ROWS = 32_768


def _vec(df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.select(ROW_ID, array_to_vector(features).alias("_v"))


def kmeans(df: DataFrame, n_clusters: int = 50, n_init: int = 10, seed: int = SEED,
           features: str = "features", max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """k-means|| init, ``n_init`` seeds (seed..seed+n_init-1), keep the lowest cost."""
    from pyspark.ml.clustering import KMeans

    data = _vec(df, features)
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, data.rdd.getNumPartitions()
    if parts < cores and data.count() > PARTITION_ROWS * parts:  # a file of many rows may be a single partition
        data = data.repartition(cores, ROW_ID)
    data = data.persist()
    best = None
    for s in range(seed, seed + n_init):
        model = KMeans(k=n_clusters, seed=s, featuresCol="_v", predictionCol=CLUSTER,
                       maxIter=max_iter, tol=tol).fit(data)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    data.unpersist()
    return best[1].transform(_vec(df, features)).select(ROW_ID, F.col(CLUSTER).cast("int").alias(CLUSTER))
