"""Cluster reports, summaries, limits and error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolens.functions.text import quality_band
from taxolens.operators import errors as ER
from taxolens.operators import reports as R
from taxolens.operators.metrics import accuracy
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.registry import register
from taxolens.plans.catalog.util import rounded
from taxolens.sources.tables import read_table


def stats_cte(src: str) -> str:
    """Unrounded R1 stats over a labeled fixture CTE ``src``."""
    return f"""cells AS (
  SELECT cluster, true_label, count(*) AS n, min(row_id) AS first_row FROM {src}
  WHERE cluster <> -1 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_row) AS rk FROM cells),
cagg AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS size, count(*) AS num_categories FROM cells GROUP BY 1),
stats AS (
  SELECT a.cluster AS cluster_id, a.size, a.size * 100.0 / (SELECT count(*) FROM {src}) AS pct,
         r.true_label AS dominant_category, r.n / a.size AS purity, a.num_categories
  FROM cagg a JOIN ranked r ON r.cluster = a.cluster AND r.rk = 1)"""


STATS_SELECT = ("SELECT cluster_id, size, round(pct, 6) AS pct, dominant_category, "
                "round(purity, 6) AS purity, num_categories FROM stats")


@register("cluster_sizes", S.with_(S.LAB_DOC, body="SELECT cluster, count(*) AS size FROM lab_doc GROUP BY 1"))
def q_cluster_sizes(spark, sf):
    return R.cluster_sizes(FX.lab_doc(spark, sf))


@register("label_set", S.with_(S.LAB_DOC, body="SELECT DISTINCT cluster FROM lab_doc WHERE cluster <> -1"))
def q_label_set(spark, sf):
    return R.label_set(FX.lab_doc(spark, sf))


@register("category_counts", S.with_(S.LAB_DOC, body="""
SELECT true_label, count(*) AS n FROM lab_doc WHERE true_label IS NOT NULL GROUP BY 1"""))
def q_category_counts(spark, sf):
    return R.category_counts(FX.lab_doc(spark, sf))


@register("top_categories", """
SELECT source AS true_label, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, true_label LIMIT 5""")
def q_top_categories(spark, sf):
    return R.top_categories(read_table(spark, sf, "documents"), 5, truth="source")


@register("category_nunique", S.with_(S.PRODUCTS, body="""
SELECT count(DISTINCT true_label) AS n_categories FROM products"""))
def q_category_nunique(spark, sf):
    return R.category_nunique(FX.products(spark, sf))


@register("dominant_category", S.with_(S.LAB_DOC, stats_cte("lab_doc"), body="""
SELECT a.cluster, a.size, r.true_label AS dominant_category, r.n AS dominant_count, a.num_categories
FROM cagg a JOIN ranked r ON r.cluster = a.cluster AND r.rk = 1"""))
def q_dominant_category(spark, sf):
    return R.dominant_category(FX.lab_doc(spark, sf))


_MAJ = """maj AS (
  SELECT c.cluster, coalesce(m.true_label, 'Unknown') AS majority_label
  FROM (SELECT DISTINCT cluster FROM prod_lab WHERE cluster <> -1) c
  LEFT JOIN (SELECT cluster, true_label, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, true_label) AS rk
             FROM (SELECT cluster, true_label, count(*) AS n FROM prod_lab
                   WHERE cluster <> -1 AND true_label IS NOT NULL GROUP BY 1, 2)) m
    ON m.cluster = c.cluster AND m.rk = 1),
pred AS (
  SELECT p.*, coalesce(m.majority_label, 'Noise') AS predicted_label
  FROM prod_lab p LEFT JOIN maj m ON p.cluster = m.cluster)"""


@register("majority_label", S.with_(S.PROD_LAB, _MAJ, body="SELECT cluster, majority_label FROM maj"))
def q_majority_label(spark, sf):
    return ER.majority_label(FX.prod_lab(spark, sf))


@register("cluster_stats", S.with_(S.LAB_DOC, stats_cte("lab_doc"), body=STATS_SELECT))
def q_cluster_stats(spark, sf):
    return rounded(R.cluster_stats(FX.lab_doc(spark, sf)))


@register("cluster_stats_no_truth", S.with_(S.LAB_DOC, body="""
SELECT cluster AS cluster_id, count(*) AS size,
       round(count(*) * 100.0 / (SELECT count(*) FROM lab_doc), 6) AS pct
FROM lab_doc WHERE cluster <> -1 GROUP BY 1"""))
def q_cluster_stats_no_truth(spark, sf):
    return rounded(R.cluster_stats(FX.lab_doc(spark, sf), truth=None))


def _pstats(spark, sf):
    return R.cluster_stats(FX.prod_lab(spark, sf))


_PSTATS = S.PROD_LAB + ",\n" + stats_cte("prod_lab")


@register("worst_clusters", S.with_(_PSTATS, body=STATS_SELECT + " ORDER BY purity, cluster_id LIMIT 10"))
def q_worst_clusters(spark, sf):
    return rounded(R.worst_clusters(_pstats(spark, sf), 10))


@register("best_clusters", S.with_(_PSTATS, body=STATS_SELECT + " ORDER BY purity DESC, cluster_id LIMIT 10"))
def q_best_clusters(spark, sf):
    return rounded(R.best_clusters(_pstats(spark, sf), 10))


@register("quality_summary", S.with_(_PSTATS, body="""
SELECT count(*) AS total_clusters, round(median(size)::DOUBLE, 6) AS median_size,
       round(avg(size), 6) AS mean_size, min(size) AS min_size, max(size) AS max_size,
       round(median(purity), 6) AS median_purity, round(avg(purity), 6) AS mean_purity,
       count(*) FILTER (WHERE purity >= 0.9) AS clusters_above_90pct,
       count(*) FILTER (WHERE purity < 0.5) AS clusters_below_50pct
FROM stats"""))
def q_quality_summary(spark, sf):
    return rounded(R.quality_summary(_pstats(spark, sf)))


def _hist_sql(values_sql: str, col: str, bins: int) -> tuple[str, str]:
    ctes = f"""vals AS ({values_sql}),
rng AS (SELECT CASE WHEN min({col}) = max({col}) THEN min({col})::DOUBLE - 0.5 ELSE min({col})::DOUBLE END AS lo,
               CASE WHEN min({col}) = max({col}) THEN max({col})::DOUBLE + 0.5 ELSE max({col})::DOUBLE END AS hi
        FROM vals),
binned AS (SELECT CAST(least(floor(({col} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin
           FROM vals, rng),
counts AS (SELECT bin, count(*) AS n FROM binned GROUP BY 1)"""
    body = f"""SELECT g.bin, round(lo + g.bin * (hi - lo) / {bins}, 6) AS bin_lo,
       round(lo + (g.bin + 1) * (hi - lo) / {bins}, 6) AS bin_hi, coalesce(c.n, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g CROSS JOIN rng
LEFT JOIN counts c ON c.bin = g.bin"""
    return ctes, body


_SH = _hist_sql("SELECT cluster, count(*) AS size FROM prod_lab WHERE cluster <> -1 GROUP BY 1", "size", 50)
_PH = _hist_sql("SELECT purity FROM stats", "purity", 20)


@register("size_histogram", S.with_(S.PROD_LAB, _SH[0], body=_SH[1]))
def q_size_histogram(spark, sf):
    return rounded(R.size_histogram(FX.prod_lab(spark, sf), 50))


@register("size_distribution", S.with_(S.PROD_LAB, _SH[0], body=f"""
SELECT bin, bin_lo, bin_hi, round(log10(bin_lo), 6) AS log_lo, round(log10(bin_hi), 6) AS log_hi, count,
       (SELECT round(median(n), 6) FROM (SELECT count(*) AS n FROM prod_lab WHERE cluster <> -1 GROUP BY cluster))
         AS median_size,
       (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM prod_lab WHERE cluster <> -1 GROUP BY cluster)) AS mean_size
FROM ({_SH[1]})"""))
def q_size_distribution(spark, sf):
    return rounded(R.size_distribution(FX.prod_lab(spark, sf), 50))


@register("purity_histogram", S.with_(_PSTATS, _PH[0], body=_PH[1]))
def q_purity_histogram(spark, sf):
    return rounded(R.purity_histogram(_pstats(spark, sf), 20))


@register("purity_bins10", S.with_(_PSTATS, body="""
SELECT g.bin, coalesce(c.n, 0) AS clusters
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) g
LEFT JOIN (SELECT CAST(least(floor(purity * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM stats GROUP BY 1) c
  ON c.bin = g.bin"""))
def q_purity_bins10(spark, sf):
    return R.purity_bins10(_pstats(spark, sf))


@register("quality_band", S.with_(_PSTATS, body="""
SELECT cluster_id, CASE WHEN purity > 0.9 THEN 'high' WHEN purity > 0.8 THEN 'medium' ELSE 'low' END AS band
FROM stats"""))
def q_quality_band(spark, sf):
    return _pstats(spark, sf).select("cluster_id", quality_band("purity").alias("band"))


def _report_sql(split: bool) -> str:
    key = ("CAST(cluster AS VARCHAR) || '__' || true_label" if split else "CAST(cluster AS VARCHAR)")
    return f"""cells AS (
  SELECT {key} AS cluster_id, true_label, count(*) AS n FROM lab_doc
  WHERE cluster <> -1 AND true_label IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, true_label) AS rk FROM cells),
rep AS (
  SELECT cluster_id, CAST(sum(n) AS BIGINT) AS size,
         max(CASE WHEN rk = 1 THEN true_label END) AS dominant_L3,
         max(CASE WHEN rk = 1 THEN n END) AS dominant_count,
         max(CASE WHEN rk = 2 THEN true_label END) AS second_L3,
         coalesce(max(CASE WHEN rk = 2 THEN n END), 0) AS second_count,
         string_agg(true_label || ':' || CAST(n AS VARCHAR), '; ' ORDER BY rk) AS top_L3_counts
  FROM ranked GROUP BY 1)"""


_REPORT_COLS = ("cluster_id, size, dominant_L3, dominant_count, second_L3, second_count, "
                "round(dominant_count / size, 6) AS purity, "
                "round((dominant_count - second_count) / size, 6) AS top2_gap, top_L3_counts")


@register("cluster_report", S.with_(S.LAB_DOC, _report_sql(False), body=f"SELECT {_REPORT_COLS} FROM rep"))
def q_cluster_report(spark, sf):
    return rounded(R.cluster_report(FX.lab_doc(spark, sf)))


@register("cluster_report_split", S.with_(S.LAB_DOC, _report_sql(True), body=f"SELECT {_REPORT_COLS} FROM rep"))
def q_cluster_report_split(spark, sf):
    return rounded(R.cluster_report(FX.lab_doc(spark, sf), split_by_label=True))


@register("top2_gap", S.with_(S.LAB_DOC, _report_sql(False), body="""
SELECT cluster_id, second_L3, round((dominant_count - second_count) / size, 6) AS top2_gap FROM rep"""))
def q_top2_gap(spark, sf):
    return rounded(R.cluster_report(FX.lab_doc(spark, sf)).select("cluster_id", "second_L3", "top2_gap"))


@register("top_label_counts", S.with_(S.LAB_DOC, _report_sql(False), body="SELECT cluster_id, top_L3_counts FROM rep"))
def q_top_label_counts(spark, sf):
    return R.cluster_report(FX.lab_doc(spark, sf)).select("cluster_id", "top_L3_counts")


@register("predict_majority", S.with_(S.PROD_LAB, _MAJ, body="""
SELECT row_id, cluster, true_label, predicted_label FROM pred"""))
def q_predict_majority(spark, sf):
    return ER.predict_majority(FX.prod_lab(spark, sf)).select("row_id", "cluster", "true_label", "predicted_label")


@register("misclassified", S.with_(S.PROD_LAB, _MAJ, body="""
SELECT row_id, true_label, predicted_label, cluster FROM pred
WHERE predicted_label IS DISTINCT FROM true_label"""))
def q_misclassified(spark, sf):
    p = ER.predict_majority(FX.prod_lab(spark, sf))
    return ER.misclassified(p).select("row_id", "true_label", "predicted_label", "cluster")


@register("misclassified_head", S.with_(S.PROD_LAB, _MAJ, body="""
SELECT true_label, predicted_label, cluster, Title, ProductName, Brand FROM pred
WHERE predicted_label IS DISTINCT FROM true_label ORDER BY row_id LIMIT 500"""))
def q_misclassified_head(spark, sf):
    return ER.error_examples(ER.predict_majority(FX.prod_lab(spark, sf)), 500)


@register("error_rate", S.with_(S.PROD_LAB, _MAJ, body="""
SELECT round(avg(CASE WHEN predicted_label IS DISTINCT FROM true_label THEN 1.0 ELSE 0.0 END), 6) AS error_rate
FROM pred"""))
def q_error_rate(spark, sf):
    return rounded(ER.error_rate(ER.predict_majority(FX.prod_lab(spark, sf))))


@register("accuracy", S.with_(S.PROD_LAB, _MAJ, body="""
SELECT round(avg(CASE WHEN predicted_label = true_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred"""))
def q_accuracy(spark, sf):
    return rounded(accuracy(ER.predict_majority(FX.prod_lab(spark, sf)), "true_label", "predicted_label"))


@register("confusion_matrix", S.with_(S.PROD_LAB, _MAJ, """top AS (SELECT true_label FROM pred WHERE true_label IS NOT NULL GROUP BY 1
          ORDER BY count(*) DESC, true_label LIMIT 20)""", """counts AS (SELECT true_label, predicted_label, count(*) AS n FROM pred
           WHERE true_label IN (SELECT * FROM top) AND predicted_label IN (SELECT * FROM top) GROUP BY 1, 2)""",
body="""SELECT t.true_label, p.true_label AS predicted_label, coalesce(c.n, 0) AS n
FROM top t CROSS JOIN top p
LEFT JOIN counts c ON c.true_label = t.true_label AND c.predicted_label = p.true_label"""))
def q_confusion_matrix(spark, sf):
    return ER.confusion_matrix(ER.predict_majority(FX.prod_lab(spark, sf)), 20)


@register("error_analysis", S.with_(S.PROD_LAB, _MAJ, body="""
SELECT count(*) FILTER (WHERE predicted_label IS DISTINCT FROM true_label) AS n_errors, count(*) AS n_rows,
       round(avg(CASE WHEN predicted_label IS DISTINCT FROM true_label THEN 1.0 ELSE 0.0 END), 6) AS error_rate
FROM pred"""))
def q_error_analysis(spark, sf):
    p = ER.predict_majority(FX.prod_lab(spark, sf))
    return rounded(p.agg(F.count(F.when(ER.is_error(), 1)).alias("n_errors"),
                         F.count(F.lit(1)).alias("n_rows"),
                         F.avg(F.when(ER.is_error(), 1.0).otherwise(0.0)).alias("error_rate")))


@register("attach_labels", S.with_(S.LAB_DOC, body="""
SELECT d.row_id, d.cluster, d.true_label, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM lab_doc d LEFT JOIN labels l ON l.doc_id = d.row_id"""))
def q_attach_labels(spark, sf):
    lab = read_table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    return FX.lab_doc(spark, sf).select("row_id", "cluster", "true_label").join(lab, "row_id", "left") \
        .fillna(-1, ["quality", "toxic"])
