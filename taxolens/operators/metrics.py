"""Contingency table and the clustering metrics derived from it.

Everything external is computed from the sparse contingency
``(true_label, cluster, n)`` — O(#cells), not O(N) — through one pass of
partial aggregates; there is no join and no pair enumeration. Noise (-1) is an
ordinary cluster unless ``noise='exclude'``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.schema import CLUSTER, NOISE, TRUTH


def _drop_noise(df: DataFrame, cluster: str, noise: str) -> DataFrame:
    if noise == "exclude":
        return df.filter(F.col(cluster) != NOISE)
    if noise != "cluster":
        raise ValueError(f"noise must be 'cluster' or 'exclude', got {noise!r}")
    return df


def contingency(df: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER,
                noise: str = "cluster") -> DataFrame:
    """A3: ``(true_label, cluster, n)``; rows with null truth are dropped.

    ``groupBy().count()`` does a map-side partial count, so a hot cell holding
    a third of all rows is pre-aggregated before the shuffle.
    """
    df = _drop_noise(df, cluster, noise)
    return (df.filter(F.col(truth).isNotNull())
            .groupBy(F.col(truth).alias(TRUTH), F.col(cluster).alias(CLUSTER))
            .agg(F.count(F.lit(1)).alias("n")))


def crosstab_wide(df: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """A3 wide form: one row per cluster, one count column per truth label.

    The label list is a distinct over the truth column (bounded by the number
    of categories) and is passed to ``pivot`` so Spark skips its own probe.
    """
    cont = contingency(df, truth, cluster)
    labels = sorted(r[0] for r in cont.select(TRUTH).distinct().collect())
    wide = cont.groupBy(CLUSTER).pivot(TRUTH, labels).agg(F.sum("n"))
    return wide.select(CLUSTER, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("long").alias(v)
                                  for v in labels])


def _xlogx(c: Column) -> Column:
    return c.cast("double") * F.log(c.cast("double"))


def contingency_sums(cont: DataFrame) -> DataFrame:
    """One row of the sufficient statistics every external metric needs.

    n, sum n_ij^2, sum n_ij ln n_ij over cells; the same over truth totals
    a_i and cluster totals b_j; number of classes/clusters; sum_j max_i n_ij.
    """
    cells = cont.select(F.lit("cell").alias("kind"), F.col("n").cast("double").alias("n"),
                        F.lit(None).cast("double").alias("mx"))
    per_truth = (cont.groupBy(TRUTH).agg(F.sum("n").cast("double").alias("n"))
                 .select(F.lit("truth").alias("kind"), "n", F.lit(None).cast("double").alias("mx")))
    per_cluster = (cont.groupBy(CLUSTER)
                   .agg(F.sum("n").cast("double").alias("n"), F.max("n").cast("double").alias("mx"))
                   .select(F.lit("cluster").alias("kind"), "n", "mx"))
    u = cells.unionByName(per_truth).unionByName(per_cluster)

    def s(kind, expr):
        return F.sum(F.when(F.col("kind") == kind, expr))

    return u.agg(
        F.coalesce(s("cell", F.col("n")), F.lit(0.0)).alias("n_total"),
        s("cell", F.col("n") * F.col("n")).alias("ss_cells"),
        s("cell", _xlogx(F.col("n"))).alias("xlx_cells"),
        s("truth", F.col("n") * F.col("n")).alias("ss_truth"),
        s("truth", _xlogx(F.col("n"))).alias("xlx_truth"),
        F.count(F.when(F.col("kind") == "truth", 1)).alias("n_classes"),
        s("cluster", F.col("n") * F.col("n")).alias("ss_clusters"),
        s("cluster", _xlogx(F.col("n"))).alias("xlx_clusters"),
        F.count(F.when(F.col("kind") == "cluster", 1)).alias("n_clusters_cont"),
        s("cluster", F.col("mx")).alias("sum_max"),
    )


def join_single_rows(base: DataFrame, *frames: DataFrame) -> DataFrame:
    """Attach the columns of one-row aggregates to ``base`` as scalar subqueries.

    Each one-row frame becomes a single struct-valued scalar subquery (run once,
    broadcast as a value) — no join, no nested-loop plan.
    """
    out = base
    for i, f in enumerate(frames):
        tmp = f"_sq{i}"
        out = out.withColumn(tmp, f.select(F.struct(*[F.col(f"`{c}`") for c in f.columns]).alias("s")).scalar())
        out = out.select(*[F.col(f"`{c}`") for c in out.columns if c != tmp],
                         *[F.col(tmp).getField(c).alias(c) for c in f.columns])
    return out


def _metric_columns() -> dict[str, Column]:
    n = F.col("n_total")
    lnn = F.log(n)
    h_true = F.when(F.col("n_classes") <= 1, F.lit(0.0)).otherwise(lnn - F.col("xlx_truth") / n)
    h_pred = F.when(F.col("n_clusters_cont") <= 1, F.lit(0.0)).otherwise(lnn - F.col("xlx_clusters") / n)
    mi_raw = (F.col("xlx_cells") + n * lnn - F.col("xlx_truth") - F.col("xlx_clusters")) / n
    mi = F.when((F.col("n_classes") <= 1) | (F.col("n_clusters_cont") <= 1), F.lit(0.0)) \
        .otherwise(F.greatest(mi_raw, F.lit(0.0)))
    s, p, q = F.col("ss_cells"), F.col("ss_clusters"), F.col("ss_truth")
    tp, fp, fn = s - n, p - s, q - s
    tn = n * n - p - q + s
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    nmi = (F.when((F.col("n_classes") == F.col("n_clusters_cont")) & (F.col("n_classes") <= 1), F.lit(1.0))
           .when(mi == 0, F.lit(0.0))
           .otherwise(mi / F.greatest((h_true + h_pred) / 2.0, F.lit(2.220446049250313e-16))))
    hom = F.when(h_true == 0, F.lit(1.0)).otherwise(mi / h_true)
    com = F.when(h_pred == 0, F.lit(1.0)).otherwise(mi / h_pred)
    vm = F.when(hom + com == 0, F.lit(0.0)).otherwise(2.0 * hom * com / (hom + com))
    fmi = F.when(tp == 0, F.lit(0.0)).otherwise(F.sqrt(tp / (p - n)) * F.sqrt(tp / (q - n)))
    return {
        "purity": F.col("sum_max") / n,
        "ari": ari,
        "nmi": nmi,
        "homogeneity": hom,
        "completeness": com,
        "v_measure": vm,
        "fowlkes_mallows": fmi,
        "mutual_info": mi,
    }


EXTERNAL = ["purity", "ari", "nmi", "homogeneity", "completeness", "v_measure", "fowlkes_mallows"]


def external_metrics(cont: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """M1-M7 as one row from a contingency table."""
    cols = _metric_columns()
    metrics = metrics or EXTERNAL
    return contingency_sums(cont).select(*[cols[m].alias(m) for m in metrics])


def noise_summary(labeling: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    """Clusters excluding noise, noise ratio, row count."""
    return labeling.agg(
        F.count_distinct(F.when(F.col(cluster) != NOISE, F.col(cluster))).alias("n_clusters"),
        F.avg(F.when(F.col(cluster) == NOISE, 1.0).otherwise(0.0)).alias("noise_ratio"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Share of rows whose prediction equals the truth."""
    return df.agg(F.avg(F.when(F.col(truth) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"))


def experiment_row(df: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """One sweep row; label count over all rows, scores over non-noise rows."""
    base = df.agg(
        F.count_distinct(truth).alias("num_L3"),
        F.count_distinct(F.when(F.col(cluster) != NOISE, F.col(cluster))).alias("num_clusters"),
        F.avg(F.when(F.col(cluster) == NOISE, 1.0).otherwise(0.0)).alias("noise_ratio"),
    )
    cont = contingency(df, truth, cluster, noise="exclude")
    per_cluster = cont.groupBy(CLUSTER).agg(F.count(F.lit(1)).alias("k"))
    avg_labels = per_cluster.agg(F.avg("k").alias("avg_L3_per_cluster"))
    ext = external_metrics(cont, ["purity", "ari", "nmi"])
    row = join_single_rows(base, avg_labels, ext)
    return row.select(
        "num_L3", "num_clusters", "noise_ratio",
        (1.0 - F.col("noise_ratio")).alias("coverage"),
        (F.col("purity") * 100.0).alias("accuracy_pct"),
        "purity", "avg_L3_per_cluster",
        F.col("ari").alias("ARI"), F.col("nmi").alias("NMI"))
