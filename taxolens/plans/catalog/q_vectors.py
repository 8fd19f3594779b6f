"""Vector operators with oracles (A14, J7, V2, V4, L3, R7, M8-M10, C1 fixed Lloyd)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolens.functions.text import truncate_sample
from taxolens.functions.vectors import distance
from taxolens.operators import reports as R
from taxolens.operators import vectors as V
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.registry import register
from taxolens.plans.catalog.util import rounded

_CENT = S.centroid_ctes("vec_lab")


@register("centroids", S.with_(S.VEC_LAB, S.centroid_ctes("vec_lab"), body="""
SELECT cluster, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS value FROM elems GROUP BY 1, 2"""))
def q_centroids(spark, sf):
    return rounded(V.centroids_long(FX.vec_lab(spark, sf)))


@register("centroid_distance", S.with_(S.VEC_LAB, _CENT, body="""
SELECT x.row_id, x.cluster, round(list_distance(x.features, c.centroid), 6) AS dist
FROM vec_lab x JOIN cent c USING (cluster)"""))
def q_centroid_distance(spark, sf):
    x = FX.vec_lab(spark, sf)
    c = V.centroids(x).withColumnRenamed("cluster", "_c")
    return rounded(x.join(c, x["cluster"] == c["_c"])
                   .select("row_id", "cluster", distance("features", "centroid").alias("dist")))


@register("nearest_centroid", S.with_(S.VEC_LAB, _CENT, body="""
SELECT row_id, cluster, round(dist, 6) AS dist FROM (
  SELECT x.row_id, c.cluster, list_distance(x.features, c.centroid) AS dist,
         row_number() OVER (PARTITION BY x.row_id ORDER BY list_distance(x.features, c.centroid), c.cluster) AS rk
  FROM vec_lab x CROSS JOIN cent c) WHERE rk = 1"""))
def q_nearest_centroid(spark, sf):
    x = FX.vec_lab(spark, sf)
    ids, C = V.collect_centroids(V.centroids(x))
    return rounded(V.assign_nearest(x.select("row_id", "features"), C, ids).select("row_id", "cluster", "dist"))


@register("lloyd_fixed", S.with_(S.VECTORS, S.lloyd_sql("vectors", 8, 5), body="""
SELECT row_id, cluster, round(dist, 6) AS dist FROM lloyd_final"""))
def q_lloyd_fixed(spark, sf):
    return rounded(V.lloyd_fixed(FX.vectors(spark, sf), 8, 5))


@register("silhouette", S.with_(S.VEC_LAB, """sizes AS (SELECT cluster, count(*) AS sz FROM vec_lab GROUP BY 1)""",
                                """pdist AS (
  SELECT a.row_id, a.cluster AS c, b.cluster AS oc, sum(list_distance(a.features, b.features)) AS s
  FROM vec_lab a CROSS JOIN vec_lab b GROUP BY 1, 2, 3)""", """per AS (
  SELECT p.row_id, max(CASE WHEN oc = c THEN sz END) AS own, max(CASE WHEN oc = c THEN s END) AS own_s,
         min(CASE WHEN oc <> c THEN s / sz END) AS b
  FROM pdist p JOIN sizes z ON z.cluster = p.oc GROUP BY 1)""", body="""
SELECT round(avg(CASE WHEN own <= 1 THEN 0.0
                      ELSE (b - own_s / (own - 1)) / greatest(own_s / (own - 1), b) END), 6) AS silhouette
FROM per"""))
def q_silhouette(spark, sf):
    return rounded(V.silhouette(FX.vec_lab(spark, sf)))


@register("davies_bouldin", S.with_(S.VEC_LAB, _CENT, """spread AS (
  SELECT x.cluster, avg(list_distance(x.features, c.centroid)) AS s
  FROM vec_lab x JOIN cent c USING (cluster) GROUP BY 1)""", """cs AS (
  SELECT c.cluster, c.centroid, s.s FROM cent c JOIN spread s USING (cluster))""", """pairs AS (
  SELECT a.cluster, max(a.s) AS s,
         max(CASE WHEN list_distance(a.centroid, b.centroid) = 0 THEN 0.0
                  ELSE (a.s + b.s) / list_distance(a.centroid, b.centroid) END) AS r,
         max(list_distance(a.centroid, b.centroid)) AS dmax
  FROM cs a CROSS JOIN cs b GROUP BY 1)""", body="""
SELECT round(CASE WHEN max(abs(s)) <= 1e-8 OR max(dmax) <= 1e-8 THEN 0.0 ELSE avg(r) END, 6) AS davies_bouldin
FROM pairs"""))
def q_davies_bouldin(spark, sf):
    return rounded(V.davies_bouldin(FX.vec_lab(spark, sf)))


@register("calinski_harabasz", S.with_(S.VEC_LAB, _CENT, """g AS (
  SELECT list(m ORDER BY pos) AS gmean FROM (SELECT pos, avg(v) AS m FROM elems GROUP BY 1))""", body="""
SELECT round(CASE WHEN w.ssw = 0 THEN 1.0 ELSE b.ssb * (w.n - b.k) / (w.ssw * (b.k - 1.0)) END, 6)
       AS calinski_harabasz
FROM (SELECT sum(c.size * list_distance(c.centroid, g.gmean) ^ 2) AS ssb, count(*) AS k FROM cent c, g) b,
     (SELECT sum(list_distance(x.features, c.centroid) ^ 2) AS ssw, count(*) AS n
      FROM vec_lab x JOIN cent c USING (cluster)) w"""))
def q_calinski_harabasz(spark, sf):
    return rounded(V.calinski_harabasz(FX.vec_lab(spark, sf)))


@register("covariance", S.with_(S.VECTORS, """el AS (
  SELECT row_id, unnest(features) AS v, unnest(range(len(features))) AS pos FROM vectors)""",
                                """mu AS (SELECT pos, avg(v) AS m FROM el GROUP BY 1)""", body="""
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j,
       round(sum((a.v - ma.m) * (b.v - mb.m)) / (count(*) - 1), 6) AS cov
FROM el a JOIN el b USING (row_id) JOIN mu ma ON ma.pos = a.pos JOIN mu mb ON mb.pos = b.pos
GROUP BY 1, 2"""))
def q_covariance(spark, sf):
    return rounded(V.covariance_long(FX.vectors(spark, sf)))


_REPS_SQL = """reps AS (
  SELECT cluster, row_id, text, dist,
         row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN size < {n} THEN 0.0 ELSE dist END, row_id) AS rank
  FROM (SELECT x.*, c.size, list_distance(x.features, c.centroid) AS dist
        FROM vec_doc x JOIN cent c USING (cluster) WHERE x.cluster <> -1))"""


@register("representatives", S.with_(S.VEC_DOC, S.centroid_ctes("vec_doc"), _REPS_SQL.format(n=3), body="""
SELECT cluster, row_id, rank, round(dist, 6) AS dist FROM reps WHERE rank <= 3"""))
def q_representatives(spark, sf):
    r = V.representatives(FX.vec_doc(spark, sf), 3)
    return rounded(r.select("cluster", "row_id", F.col("rank").cast("long").alias("rank"), "dist"))


def worst_clusters_analysis(df, n_worst: int = 10, n_samples: int = 2):
    """Worst clusters by purity with two central sample texts (≤ 200 chars)."""
    stats = R.worst_clusters(R.cluster_stats(df), n_worst)
    reps = V.representatives(df, n_samples).select(
        F.col("cluster").alias("cluster_id"), "rank", "text")
    samples = (reps.groupBy("cluster_id")
               .agg(F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("s1"),
                    F.max(F.when(F.col("rank") == 2, F.col("text"))).alias("s2")))
    return (stats.join(samples, "cluster_id", "left")
            .select("cluster_id", "size", "purity", "dominant_category", "num_categories",
                    truncate_sample("s1").alias("sample_1"), truncate_sample("s2").alias("sample_2")))


_R7_STATS = """cells AS (
  SELECT cluster, true_label, count(*) AS n, min(row_id) AS first_row FROM vec_doc
  WHERE cluster <> -1 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first_row) AS rk FROM cells),
cagg AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS size, count(*) AS num_categories FROM cells GROUP BY 1),
stats AS (
  SELECT a.cluster AS cluster_id, a.size, r.true_label AS dominant_category, r.n / a.size AS purity,
         a.num_categories
  FROM cagg a JOIN ranked r ON r.cluster = a.cluster AND r.rk = 1),
worst AS (SELECT * FROM stats ORDER BY purity, cluster_id LIMIT 10)"""


@register("worst_clusters_analysis", S.with_(S.VEC_DOC, S.centroid_ctes("vec_doc"), _REPS_SQL.format(n=2),
                                             _R7_STATS, body="""
SELECT w.cluster_id, w.size, round(w.purity, 6) AS purity, w.dominant_category, w.num_categories,
       coalesce(substr(max(CASE WHEN r.rank = 1 THEN r.text END), 1, 200), 'N/A') AS sample_1,
       coalesce(substr(max(CASE WHEN r.rank = 2 THEN r.text END), 1, 200), 'N/A') AS sample_2
FROM worst w LEFT JOIN reps r ON r.cluster = w.cluster_id AND r.rank <= 2
GROUP BY 1, 2, 3, 4, 5"""))
def q_worst_clusters_analysis(spark, sf):
    return rounded(worst_clusters_analysis(FX.vec_doc(spark, sf)))


@register("pairwise_distance", S.with_(S.VEC_LAB, """firsts AS (
  SELECT x.cluster, x.features AS f0 FROM vec_lab x
  JOIN (SELECT cluster, min(row_id) AS r0 FROM vec_lab GROUP BY 1) m ON m.cluster = x.cluster AND m.r0 = x.row_id)""",
                                        body="""
SELECT x.row_id, x.cluster, round(list_distance(x.features, f.f0), 6) AS dist
FROM vec_lab x JOIN firsts f USING (cluster)"""))
def q_pairwise_distance(spark, sf):
    """V4: Euclidean distance of every row to its cluster's first row (by row_id)."""
    x = FX.vec_lab(spark, sf)
    first_ids = x.groupBy("cluster").agg(F.min("row_id").alias("row_id"))
    firsts = x.join(first_ids, ["cluster", "row_id"]).select("cluster", F.col("features").alias("f0"))
    return rounded(x.join(firsts, "cluster").select("row_id", "cluster", distance("features", "f0").alias("dist")))
