"""Helpers shared by catalog modules: rounding and metric SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column so both engines hash the same values."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def sums_sql(cont: str = "cont") -> str:
    """CTE body: one row of contingency sufficient statistics."""
    return f"""(SELECT
  (SELECT coalesce(sum(n), 0)::DOUBLE FROM {cont}) AS n_total,
  (SELECT sum(n::DOUBLE * n) FROM {cont}) AS ss_cells,
  (SELECT sum(n::DOUBLE * ln(n)) FROM {cont}) AS xlx_cells,
  (SELECT sum(a * a) FROM (SELECT sum(n)::DOUBLE AS a FROM {cont} GROUP BY true_label)) AS ss_truth,
  (SELECT sum(a * ln(a)) FROM (SELECT sum(n)::DOUBLE AS a FROM {cont} GROUP BY true_label)) AS xlx_truth,
  (SELECT count(DISTINCT true_label) FROM {cont}) AS n_classes,
  (SELECT sum(b * b) FROM (SELECT sum(n)::DOUBLE AS b FROM {cont} GROUP BY cluster)) AS ss_clusters,
  (SELECT sum(b * ln(b)) FROM (SELECT sum(n)::DOUBLE AS b FROM {cont} GROUP BY cluster)) AS xlx_clusters,
  (SELECT count(DISTINCT cluster) FROM {cont}) AS n_clusters_cont,
  (SELECT sum(m) FROM (SELECT max(n)::DOUBLE AS m FROM {cont} GROUP BY cluster)) AS sum_max)"""


def metric_sql() -> dict[str, str]:
    """SQL expressions over the sums row (columns of ``sums_sql``)."""
    n = "n_total"
    h_t = f"(CASE WHEN n_classes <= 1 THEN 0.0 ELSE ln({n}) - xlx_truth / {n} END)"
    h_p = f"(CASE WHEN n_clusters_cont <= 1 THEN 0.0 ELSE ln({n}) - xlx_clusters / {n} END)"
    mi = (f"(CASE WHEN n_classes <= 1 OR n_clusters_cont <= 1 THEN 0.0 ELSE "
          f"greatest((xlx_cells + {n} * ln({n}) - xlx_truth - xlx_clusters) / {n}, 0.0) END)")
    tp, fp, fn = f"(ss_cells - {n})", "(ss_clusters - ss_cells)", "(ss_truth - ss_cells)"
    tn = f"({n} * {n} - ss_clusters - ss_truth + ss_cells)"
    ari = (f"(CASE WHEN {fn} = 0 AND {fp} = 0 THEN 1.0 ELSE 2.0 * ({tp} * {tn} - {fn} * {fp}) / "
           f"(({tp} + {fn}) * ({fn} + {tn}) + ({tp} + {fp}) * ({fp} + {tn})) END)")
    nmi = (f"(CASE WHEN n_classes = n_clusters_cont AND n_classes <= 1 THEN 1.0 WHEN {mi} = 0 THEN 0.0 "
           f"ELSE {mi} / greatest(({h_t} + {h_p}) / 2.0, 2.220446049250313e-16) END)")
    hom = f"(CASE WHEN {h_t} = 0 THEN 1.0 ELSE {mi} / {h_t} END)"
    com = f"(CASE WHEN {h_p} = 0 THEN 1.0 ELSE {mi} / {h_p} END)"
    vm = f"(CASE WHEN {hom} + {com} = 0 THEN 0.0 ELSE 2.0 * {hom} * {com} / ({hom} + {com}) END)"
    fmi = (f"(CASE WHEN {tp} = 0 THEN 0.0 ELSE sqrt({tp} / (ss_clusters - {n})) * "
           f"sqrt({tp} / (ss_truth - {n})) END)")
    return {"purity": f"(sum_max / {n})", "ari": ari, "nmi": nmi, "homogeneity": hom,
            "completeness": com, "v_measure": vm, "fowlkes_mallows": fmi}


def metrics_select(names: list[str], cont: str = "cont", digits: int = DIGITS) -> str:
    m = metric_sql()
    cols = ", ".join(f"round({m[k]}, {digits}) AS {k}" for k in names)
    return f"SELECT {cols} FROM {sums_sql(cont)}"


def internal_sql(src: str, p: str) -> tuple[str, str]:
    """(CTEs, select-list) computing silhouette, Davies-Bouldin and Calinski-Harabasz
    over a CTE ``src(row_id, features, cluster)``; CTE names are prefixed by ``p``."""
    ctes = f"""{p}sizes AS (SELECT cluster, count(*) AS sz FROM {src} GROUP BY 1),
{p}pdist AS (
  SELECT a.row_id, a.cluster AS c, b.cluster AS oc, sum(list_distance(a.features, b.features)) AS s
  FROM {src} a CROSS JOIN {src} b GROUP BY 1, 2, 3),
{p}per AS (
  SELECT p.row_id, max(CASE WHEN oc = c THEN sz END) AS own, max(CASE WHEN oc = c THEN s END) AS own_s,
         min(CASE WHEN oc <> c THEN s / sz END) AS b
  FROM {p}pdist p JOIN {p}sizes z ON z.cluster = p.oc GROUP BY 1),
{p}elems AS (SELECT row_id, cluster, unnest(features) AS v, unnest(range(len(features))) AS pos FROM {src}),
{p}cent AS (
  SELECT cluster, max(sz) AS size, list(value ORDER BY pos) AS centroid FROM (
    SELECT cluster, pos, avg(v) AS value, count(*) AS sz FROM {p}elems GROUP BY 1, 2) GROUP BY 1),
{p}spread AS (
  SELECT x.cluster, avg(list_distance(x.features, c.centroid)) AS s
  FROM {src} x JOIN {p}cent c USING (cluster) GROUP BY 1),
{p}cs AS (SELECT c.cluster, c.centroid, s.s FROM {p}cent c JOIN {p}spread s USING (cluster)),
{p}pairs AS (
  SELECT a.cluster, max(a.s) AS s,
         max(CASE WHEN list_distance(a.centroid, b.centroid) = 0 THEN 0.0
                  ELSE (a.s + b.s) / list_distance(a.centroid, b.centroid) END) AS r,
         max(list_distance(a.centroid, b.centroid)) AS dmax
  FROM {p}cs a CROSS JOIN {p}cs b GROUP BY 1),
{p}g AS (SELECT list(m ORDER BY pos) AS gmean FROM (SELECT pos, avg(v) AS m FROM {p}elems GROUP BY 1)),
{p}ch AS (
  SELECT CASE WHEN w.ssw = 0 THEN 1.0 ELSE b.ssb * (w.n - b.k) / (w.ssw * (b.k - 1.0)) END AS v
  FROM (SELECT sum(c.size * list_distance(c.centroid, g.gmean) ^ 2) AS ssb, count(*) AS k FROM {p}cent c, {p}g g) b,
       (SELECT sum(list_distance(x.features, c.centroid) ^ 2) AS ssw, count(*) AS n
        FROM {src} x JOIN {p}cent c USING (cluster)) w)"""
    sel = (f"(SELECT avg(CASE WHEN own <= 1 THEN 0.0 ELSE (b - own_s / (own - 1)) / "
           f"greatest(own_s / (own - 1), b) END) FROM {p}per) AS silhouette, "
           f"(SELECT CASE WHEN max(abs(s)) <= 1e-8 OR max(dmax) <= 1e-8 THEN 0.0 ELSE avg(r) END "
           f"FROM {p}pairs) AS davies_bouldin, (SELECT v FROM {p}ch) AS calinski_harabasz")
    return ctes, sel


def full_metrics_sql(src: str, p: str) -> tuple[str, str]:
    """(CTEs, select-list) of the M14 record (unrounded) for a labeled vector CTE with truth."""
    ictes, isel = internal_sql(src, p)
    ctes = ictes + f""",
{p}cont AS (SELECT true_label, cluster, count(*) AS n FROM {src} WHERE true_label IS NOT NULL GROUP BY 1, 2),
{p}sums AS {sums_sql(p + 'cont')}"""
    m = metric_sql()
    ext = ", ".join(f"(SELECT {m[k]} FROM {p}sums) AS {k}" for k in
                    ["purity", "ari", "nmi", "homogeneity", "completeness", "v_measure", "fowlkes_mallows"])
    sel = (f"(SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) FROM {src}) AS n_clusters, "
           f"(SELECT avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END) FROM {src}) AS noise_ratio, "
           f"{isel}, {ext}")
    return ctes, sel
