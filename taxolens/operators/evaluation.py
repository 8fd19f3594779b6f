"""M14 full metrics record and the comparison report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.metrics import EXTERNAL, contingency, external_metrics, join_single_rows, noise_summary
from taxolens.operators.vectors import calinski_harabasz, cluster_moments, davies_bouldin, silhouette
from taxolens.schema import CLUSTER, ROW_ID, TRUTH
from taxolens.session import cut_lineage
from taxolens.sources.sampling import restrict_to, sample_ids

INTERNAL = ["silhouette", "davies_bouldin", "calinski_harabasz"]
# Fixed value: the report's preferred leading columns, in this order.
REPORT_ORDER = ["purity", "nmi", "ari", "v_measure", "fowlkes_mallows", "homogeneity", "completeness",
                "silhouette", "n_clusters"]


def compute_metrics(df: DataFrame, features: str | None = "features", cluster: str = CLUSTER,
                    truth: str | None = TRUTH, silhouette_sample: int | None = None, seed: int = 42,
                    score: DataFrame | None = None) -> DataFrame:
    """One row: n_clusters, noise_ratio, then (if ≥ 2 clusters) internal and external metrics; noise is a cluster.

    All metrics are of all rows. Silhouette compares all pairs of rows: ``silhouette_sample`` asks for a seeded
    sample of that many rows for it alone. ``score`` is the silhouette, if it is there already, as from
    ``silhouettes`` for several labelings of the same rows.
    """
    ns = noise_summary(df, cluster).drop("n_rows")
    k = ns.first()["n_clusters"]
    cols = [F.col("n_clusters"), F.col("noise_ratio")]
    if k < 2:
        nulls = [F.lit(None).cast("double").alias(m) for m in INTERNAL + (EXTERNAL if truth else [])]
        return ns.select(*cols, *nulls)
    parts = [ns]
    if features:
        base = df.select(ROW_ID, features, F.col(cluster).alias(CLUSTER))
        if score is None:
            some = base if silhouette_sample is None else restrict_to(base, sample_ids(base, silhouette_sample, seed=seed))
            score = silhouette(some, features)
        moments = cut_lineage(cluster_moments(base, features))
        parts += [score.select("silhouette"), davies_bouldin(base, features, moments=moments),
                  calinski_harabasz(base, features, moments=moments)]
    if truth:
        parts.append(external_metrics(contingency(df, truth, cluster)))
    return join_single_rows(*parts)


def results_table(records: dict[str, DataFrame]) -> DataFrame:
    """One row per algorithm (union of columns), preferred columns first."""
    out = None
    for i, (name, rec) in enumerate(records.items()):
        row = rec.select(F.lit(name).alias("algorithm"), F.lit(i).alias("algo_ord"), "*")
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    lead = [c for c in REPORT_ORDER if c in out.columns]
    rest = [c for c in out.columns if c not in lead and c not in ("algorithm", "algo_ord")]
    return out.select("algorithm", "algo_ord", *lead, *rest)


def metrics_long(results: DataFrame) -> DataFrame:
    """(Algorithm, Metric, Score) over purity, nmi, ari, silhouette where present."""
    metrics = [m for m in ["purity", "nmi", "ari", "silhouette"] if m in results.columns]
    return (results.select(F.col("algorithm").alias("Algorithm"), *[F.col(m).cast("double") for m in metrics])
            .unpivot("Algorithm", metrics, "Metric", "Score"))


def best_model(results: DataFrame, clustering_only: list[str] | None = None) -> DataFrame:
    """The highest-purity model that produced labels; ties → first run."""
    r = results.filter(F.col("purity").isNotNull())
    if clustering_only is not None:
        r = r.filter(F.col("algorithm").isin(clustering_only))
    return r.orderBy(F.col("purity").desc(), F.col("algo_ord")).limit(1).select("algorithm", "purity")


def best_runs(experiments: DataFrame, n: int = 10) -> DataFrame:
    """Top n experiment rows by accuracy (ties by run order)."""
    return experiments.orderBy(F.col("accuracy_pct").desc(), F.col("run")).limit(n)
