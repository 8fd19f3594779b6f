"""Model fits (C1-C3, V2, V3, T1, T3) and the evaluation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolens.operators import evaluation as EV
from taxolens.operators.clustering.bisecting import bisecting_kmeans, bisecting_tree
from taxolens.operators.clustering.kmeans import kmeans
from taxolens.operators.clustering.minibatch import minibatch_kmeans
from taxolens.operators.metrics import experiment_row
from taxolens.operators.supervised import run_baseline, train_test_split
from taxolens.operators.tuning import best_of, tune_hyperparameters
from taxolens.operators.vectors import pca, silhouettes
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.registry import register
from taxolens.plans.catalog.util import DIGITS, full_metrics_sql, rounded, sums_sql, metric_sql
from taxolens.session import cut_lineage
from taxolens.sources.sampling import sample_exact


@register("kmeans")
def q_kmeans(spark, sf):
    return kmeans(FX.vectors(spark, sf), n_clusters=8, n_init=3)


@register("bisecting_kmeans")
def q_bisecting_kmeans(spark, sf):
    return bisecting_kmeans(FX.vectors(spark, sf), n_clusters=8)


@register("bisecting_totals", S.with_(S.VECTORS, body="""
SELECT 8::BIGINT AS n_clusters, count(*) AS n_rows, TRUE AS no_empty, TRUE AS largest_first FROM vectors"""))
def q_bisecting_totals(spark, sf):
    """What a bisecting fit keeps: exactly k clusters over all rows, each split that of the leaf with most inertia."""
    v = FX.vectors(spark, sf)
    tree = bisecting_tree(v, 8)
    sizes = bisecting_kmeans(v, 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_rows"),
                     (F.min("n") > 0).alias("no_empty"), F.lit(tree.largest_first(8)).alias("largest_first"))


@register("minibatch_kmeans")
def q_minibatch_kmeans(spark, sf):
    return minibatch_kmeans(FX.vectors(spark, sf), n_clusters=8, batch_size=128, max_iter=20)


@register("pca")
def q_pca(spark, sf):
    return pca(FX.vectors(spark, sf), 8).select("row_id", "pca")


@register("projection_sample")
def q_projection_sample(spark, sf):
    """V3: ≤10k seeded sample, 2-D centred PCA, with truth and every labeling's cluster."""
    lab = FX.vd_lab(spark, sf)
    rows = lab.filter(F.col("algo_ord") == 0).select("row_id", "features", "true_label")
    sample = sample_exact(rows, 10000)
    proj = pca(sample, 2, out="xy").select("row_id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"),
                                           "true_label")
    return proj.join(lab.select("row_id", "algo", "cluster"), "row_id")


@register("train_test_split", S.with_(S.VECTORS, body="""
SELECT row_id, true_label,
       CAST(('x' || substr(md5('42|' || CAST(row_id AS VARCHAR)), 1, 8))::BIT::UBIGINT AS DOUBLE) / 4294967296.0 < 0.2
         AS is_test
FROM vectors WHERE true_label IS NOT NULL""".replace("('x' || substr(md5('42|' || CAST(row_id AS VARCHAR)), 1, 8))::BIT::UBIGINT",
                                                  "CAST(('0x' || substr(md5('42|' || CAST(row_id AS VARCHAR)), 1, 8)) AS UBIGINT)")))
def q_train_test_split(spark, sf):
    return train_test_split(FX.vectors(spark, sf)).select("row_id", "true_label", "is_test")


@register("supervised_baseline")
def q_supervised_baseline(spark, sf):
    metrics, _ = run_baseline(FX.vec_doc(spark, sf).select("row_id", "features", "true_label"), max_iter=100)
    return metrics


_LLOYD_GRID = {"n_clusters": [4, 8], "iterations": [3]}


@register("tuning_results")
def q_tuning_results(spark, sf):
    _, _, res = tune_hyperparameters(FX.vectors(spark, sf), "Lloyd", _LLOYD_GRID)
    return rounded(res.drop("time"))


@register("tuning_best")
def q_tuning_best(spark, sf):
    _, _, res = tune_hyperparameters(FX.vectors(spark, sf), "Lloyd", _LLOYD_GRID)
    return rounded(best_of(res).drop("time"))


def _records(spark, sf):
    lab = FX.vd_wide(spark, sf).persist()
    # all pairs of rows are compared once for the three labelings
    scores = cut_lineage(silhouettes(lab, FX.VD_ALGOS))
    return {a: EV.compute_metrics(lab.select("row_id", "features", "true_label", F.col(a).alias("cluster")),
                                  score=scores.select(F.col(a).alias("silhouette"))) for a in FX.VD_ALGOS}


_M14_COLS = ["n_clusters", "noise_ratio", "silhouette", "davies_bouldin", "calinski_harabasz", "purity", "ari",
             "nmi", "homogeneity", "completeness", "v_measure", "fowlkes_mallows"]


def _results_ctes() -> list[str]:
    ctes, sels = [S.VD_LAB], []
    for i, a in enumerate(FX.VD_ALGOS):
        src = f"vd_{a}"
        ctes.append(f"{src} AS (SELECT row_id, features, true_label, cluster FROM vd_lab WHERE algo = '{a}')")
        c, s = full_metrics_sql(src, f"{a}_")
        ctes.append(c)
        sels.append(f"SELECT '{a}' AS algorithm, {i} AS algo_ord, {s}")
    rounded_cols = ", ".join(f"round({c}, {DIGITS}) AS {c}" if c != "n_clusters" else c for c in _M14_COLS)
    ctes.append("res AS (" + "\nUNION ALL\n".join(sels) + ")")
    ctes.append(f"res_final AS (SELECT algorithm, algo_ord, {rounded_cols} FROM res)")
    return ctes


_RC = _results_ctes()


@register("compute_metrics", S.with_(S.VD_LAB, "vd_label AS (SELECT row_id, features, true_label, cluster FROM vd_lab WHERE algo = 'label')",
                                     full_metrics_sql("vd_label", "m_")[0],
                                     body="SELECT " + ", ".join(
                                         f"round(v.{c}, {DIGITS}) AS {c}" if c != "n_clusters" else f"v.{c}"
                                         for c in _M14_COLS) + " FROM (SELECT " + full_metrics_sql("vd_label", "m_")[1] + ") v"))
def q_compute_metrics(spark, sf):
    lab = FX.vd_lab(spark, sf).filter(F.col("algo") == "label")
    return rounded(EV.compute_metrics(lab)).select(*_M14_COLS)


@register("results_table", S.with_(*_RC, body="SELECT * FROM res_final"))
def q_results_table(spark, sf):
    return rounded(EV.results_table(_records(spark, sf)))


@register("metrics_long", S.with_(*_RC, body="""
SELECT Algorithm, Metric, Score
FROM (SELECT algorithm AS Algorithm, purity, nmi, ari, silhouette FROM res_final)
UNPIVOT INCLUDE NULLS (Score FOR Metric IN (purity, nmi, ari, silhouette))"""))
def q_metrics_long(spark, sf):
    return EV.metrics_long(rounded(EV.results_table(_records(spark, sf))))


@register("best_model", S.with_(*_RC, body="SELECT algorithm, purity FROM res_final ORDER BY purity DESC, algo_ord LIMIT 1"))
def q_best_model(spark, sf):
    return EV.best_model(rounded(EV.results_table(_records(spark, sf))))


def _exp_sql() -> str:
    m = metric_sql()
    sels = []
    ctes = [S.VD_LAB]
    for i, a in enumerate(FX.VD_ALGOS):
        ctes.append(f"""{a}_cont AS (SELECT true_label, cluster, count(*) AS n FROM vd_lab
  WHERE algo = '{a}' AND cluster <> -1 AND true_label IS NOT NULL GROUP BY 1, 2)""")
        ctes.append(f"{a}_sums AS {sums_sql(a + '_cont')}")
        sels.append(f"""SELECT {i} AS run, (SELECT count(DISTINCT true_label) FROM vd_lab WHERE algo = '{a}') AS num_L3,
  (SELECT count(DISTINCT cluster) FROM vd_lab WHERE algo = '{a}' AND cluster <> -1) AS num_clusters,
  (SELECT avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END) FROM vd_lab WHERE algo = '{a}') AS noise_ratio,
  (SELECT {m['purity']} FROM {a}_sums) AS purity,
  (SELECT avg(k) FROM (SELECT count(*) AS k FROM {a}_cont GROUP BY cluster)) AS avg_L3_per_cluster,
  (SELECT {m['ari']} FROM {a}_sums) AS ARI, (SELECT {m['nmi']} FROM {a}_sums) AS NMI""")
    ctes.append("ex AS (" + "\nUNION ALL\n".join(sels) + ")")
    return S.with_(*ctes, body=f"""
SELECT run, num_L3, num_clusters, round(noise_ratio, 6) AS noise_ratio, round(1.0 - noise_ratio, 6) AS coverage,
       round(purity * 100.0, 6) AS accuracy_pct, round(purity, 6) AS purity,
       round(avg_L3_per_cluster, 6) AS avg_L3_per_cluster, round(ARI, 6) AS ARI, round(NMI, 6) AS NMI
FROM ex ORDER BY accuracy_pct DESC, run LIMIT 10""")


@register("best_runs", _exp_sql())
def q_best_runs(spark, sf):
    # only what an experiment row reads is kept, not the vectors
    lab = FX.vd_lab(spark, sf).select("algo", "true_label", "cluster").persist()
    rows = None
    for i, a in enumerate(FX.VD_ALGOS):
        r = experiment_row(lab.filter(F.col("algo") == a)).select(F.lit(i).alias("run"), "*")
        rows = r if rows is None else rows.unionByName(r)
    return EV.best_runs(rounded(rows), 10)


@register("results_with_baseline")
def q_results_with_baseline(spark, sf):
    recs = _records(spark, sf)
    metrics, _ = run_baseline(FX.vec_doc(spark, sf).select("row_id", "features", "true_label"), max_iter=100)
    recs["Supervised Baseline"] = metrics
    return rounded(EV.results_table(recs))
