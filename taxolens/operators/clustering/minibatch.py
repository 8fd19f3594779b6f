"""C2 mini-batch k-means as a driver loop of Spark jobs.

One scan draws the batches of all steps (≈ batch_size rows each, selected by a hash
of row and step) into a table with a part for each step; a step reads its part only,
assigns it to the broadcast centres, reduces
per-centre sums with per-partition numpy partials, and applies the
count-weighted update c ← c + (Σx − n·c)/N_c (per-centre learning rate 1/count).
Initial centres: Spark k-means|| on a seeded sample of ``3·batch_size`` rows,
``n_init`` seeds, lowest cost kept. Stops on centre shift ≤ tol or max_iter.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.vectors import assign_nearest, cluster_sums
from taxolens.schema import CLUSTER, ROW_ID, SEED
from taxolens.session import ensure_checkpoint_dir
from taxolens.sources.sampling import sample_exact


def _init_centres(df: DataFrame, k: int, features: str, init_size: int, n_init: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    init = sample_exact(df.select(ROW_ID, features), init_size, seed=seed)
    vec = init.select(array_to_vector(features).alias("_v")).persist()
    best = None
    for s in range(seed, seed + n_init):
        m = KMeans(k=k, seed=s, featuresCol="_v", maxIter=1, initSteps=2).fit(vec)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    vec.unpersist()
    return np.array([np.asarray(c, dtype=np.float64) for c in best[1].clusterCenters()])


def draw_batches(data: DataFrame, n_batches: int, steps: int, seed: int) -> DataFrame:
    """The rows of every step with its number ``step``, about one in ``n_batches`` each, as a table parted by step."""
    spark = data.sparkSession
    drawn = data.withColumn("step", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda it: F.pmod(F.xxhash64(F.col(ROW_ID), F.lit(seed), it), F.lit(n_batches)) == 0)))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    drawn.repartition("step").write.partitionBy("step").parquet(folder)
    return spark.read.schema(drawn.schema).parquet(folder)


def minibatch_kmeans(df: DataFrame, n_clusters: int = 100, batch_size: int = 1024, n_init: int = 3,
                     max_iter: int = 100, tol: float = 1e-4, seed: int = SEED,
                     features: str = "features") -> DataFrame:
    data = df.select(ROW_ID, features)
    n = data.count()
    C = _init_centres(data, n_clusters, features, min(n, 3 * batch_size), n_init, seed)
    counts = np.zeros(len(C))
    batches = draw_batches(data, max(1, n // max(1, batch_size)), max_iter, seed)
    for it in range(max_iter):
        batch = batches.filter(F.col("step") == it).drop("step")
        lab = assign_nearest(batch, C, features=features, dist_col=None)
        sums = cluster_sums(lab, features, CLUSTER).collect()  # ≤ k×d rows
        if not sums:
            continue
        S = np.zeros_like(C)
        m = np.zeros(len(C))
        for r in sums:
            S[r["cluster"], r["pos"]] = r["s"]
            m[r["cluster"]] = r["n"]
        old = C.copy()
        hit = m > 0
        counts[hit] += m[hit]
        C[hit] += (S[hit] - m[hit, None] * C[hit]) / counts[hit, None]
        if np.sqrt(((C - old) ** 2).sum(axis=1)).max() <= tol:
            break
    out = assign_nearest(data, C, features=features, dist_col=None).select(ROW_ID, CLUSTER)
    return out
