"""Flows, composition, payload scan and explorer datasets (A9-A12, J3, J4, P11, P12, P16,
S8, S9, U2, U6, F6, F7, F9, L6, R13-R15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolens.functions.text import cluster_node_name
from taxolens.operators import explorer as X
from taxolens.operators import flows as FL
from taxolens.operators import reports as R
from taxolens.plans import fixtures as FX
from taxolens.plans.catalog import sqlfix as S
from taxolens.plans.catalog.q_reports import stats_cte
from taxolens.plans.catalog.registry import register
from taxolens.plans.catalog.util import rounded

_SK = S.sankey_ctes("flow_src")


@register("sankey_nodes", S.with_(S.FLOW_SRC, _SK, body="""
SELECT idx, true_label AS name, 'category' AS kind FROM tix
UNION ALL
SELECT ci + (SELECT nt FROM ntix), 'Cluster ' || CAST(cluster AS VARCHAR), 'cluster' FROM cix"""))
def q_sankey_nodes(spark, sf):
    return FL.sankey_nodes(FL.flow_subset(FX.flow_src(spark, sf)))


@register("sankey_flows", S.with_(S.FLOW_SRC, _SK, body="SELECT source, target, value, true_label, cluster FROM flows"))
def q_sankey_flows(spark, sf):
    return FL.sankey_flows(FL.flow_subset(FX.flow_src(spark, sf)))


@register("flow_indexed", S.with_(S.FLOW_SRC, _SK, """nodes AS (
  SELECT idx, true_label AS name FROM tix
  UNION ALL SELECT ci + (SELECT nt FROM ntix), 'Cluster ' || CAST(cluster AS VARCHAR) FROM cix)""", body="""
SELECT f.source, f.target, s.name AS source_name, t.name AS target_name, f.value
FROM flows f JOIN nodes s ON s.idx = f.source JOIN nodes t ON t.idx = f.target"""))
def q_flow_indexed(spark, sf):
    sub = FL.flow_subset(FX.flow_src(spark, sf))
    nodes = FL.sankey_nodes(sub)
    fl = FL.sankey_flows(sub)
    s = nodes.select(F.col("idx").alias("source"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("idx").alias("target"), F.col("name").alias("target_name"))
    return fl.join(s, "source").join(t, "target").select("source", "target", "source_name", "target_name", "value")


def _links(spark, sf):
    fl = FL.sankey_flows(FL.flow_subset(FX.flow_src(spark, sf)))
    fwd = fl.select(F.col("true_label").alias("source_name"), cluster_node_name("cluster").alias("target_name"), "value")
    rev = fl.filter(F.col("cluster") % 2 == 0).select(cluster_node_name("cluster").alias("source_name"),
                                                      F.col("true_label").alias("target_name"), "value")
    mixed = fl.select(F.col("true_label").alias("source_name"), F.col("true_label").alias("target_name"), "value")
    return fwd.unionByName(rev).unionByName(mixed)


@register("flow_direction", S.with_(S.FLOW_SRC, _SK, """links AS (
  SELECT true_label AS s, 'Cluster ' || CAST(cluster AS VARCHAR) AS t, value FROM flows
  UNION ALL SELECT 'Cluster ' || CAST(cluster AS VARCHAR), true_label, value FROM flows WHERE cluster % 2 = 0
  UNION ALL SELECT true_label, true_label, value FROM flows)""", body="""
SELECT CASE WHEN t LIKE '%Cluster%' THEN trim(replace(t, 'Cluster ', '')) ELSE trim(replace(s, 'Cluster ', '')) END
         AS cluster_id,
       CASE WHEN t LIKE '%Cluster%' THEN s ELSE t END AS category, value AS count
FROM links WHERE (t LIKE '%Cluster%') <> (s LIKE '%Cluster%')"""))
def q_flow_direction(spark, sf):
    return FL.parse_flow_names(_links(spark, sf))


def _items(src: str) -> str:
    return (f"SELECT CAST(cluster AS VARCHAR) AS cluster_id, true_label AS name, count(*) AS count FROM {src} "
            "WHERE true_label IS NOT NULL GROUP BY ALL")


@register("composition", S.with_(S.FLOW_SRC, _SK, S.composition_ctes(_items("flow_src")), body="""
SELECT cluster_id, rank, name, count, percentage, total_size, round(purity, 6) AS purity, dominant_category FROM comp"""))
def q_composition(spark, sf):
    return rounded(FL.composition(FL.flow_items(FX.flow_src(spark, sf))))


@register("composition_nested")
def q_composition_nested(spark, sf):
    return FL.composition_nested(FL.flow_items(FX.flow_src(spark, sf)))


_BROKEN = "src"  # this algorithm's page loses its "value" array and must be skipped


def _payload_pages(spark, sf):
    lab = FX.labelings(spark, sf)
    docs = FX.flow_src(spark, sf).select("row_id", "true_label")
    pages = None
    for algo in ["src", "mod", "dec"]:
        sub = FL.flow_subset(lab.filter(F.col("algo") == algo).join(docs, "row_id"))
        nodes, fl = FL.sankey(sub)
        nodes, fl = nodes.withColumn("algo", F.lit(algo)), fl.withColumn("algo", F.lit(algo))
        page = FL.flow_payload(nodes, fl, "algo")
        pages = page if pages is None else pages.unionByName(page)
    return pages.withColumn("html", F.when(F.col("algo") == _BROKEN,
                                           F.regexp_replace("html", r'"value": \[[^\]]*\]', '"v": []'))
                            .otherwise(F.col("html")))


_PAY_SRC = """pay_src AS (
  SELECT l.algo, l.row_id, l.cluster, d.source AS true_label
  FROM labelings l JOIN documents d ON d.doc_id = l.row_id)"""


@register("extract_embedded_links", S.with_(S.LABELINGS, _PAY_SRC, S.sankey_ctes("pay_src", part="algo"), body=f"""
SELECT algo, CAST(row_number() OVER (PARTITION BY algo ORDER BY source, target) - 1 AS INTEGER) AS pos,
       CAST(cluster AS VARCHAR) AS cluster_id, true_label AS category, CAST(value AS DOUBLE) AS count
FROM flows WHERE algo <> '{_BROKEN}'"""))
def q_extract_embedded_links(spark, sf):
    return FL.extract_embedded_links(_payload_pages(spark, sf), "algo")


# ------------------------------------------------------------------ explorer

_PSTATS = S.PROD_LAB + ",\n" + stats_cte("prod_lab")
_PSK = S.sankey_ctes("prod_lab")
_EXP = S.with_(_PSTATS, _PSK, S.composition_ctes(_items("prod_lab")), body="")


def _exp(body: str) -> str:
    return _EXP + body


def _clusters(spark, sf):
    return R.cluster_stats(FX.prod_lab(spark, sf)).select("cluster_id", "size", "purity", "dominant_category")


def _rich(spark, sf):
    return FL.composition(FL.flow_items(FX.prod_lab(spark, sf)))


@register("explorer_inputs", _exp("""
SELECT s.cluster_id, s.size, round(s.purity, 6) AS purity, s.dominant_category, coalesce(l.n, 0) AS n_leaves
FROM stats s LEFT JOIN (SELECT cluster_id, count(*) AS n FROM comp GROUP BY 1) l
  ON l.cluster_id = CAST(s.cluster_id AS VARCHAR)"""))
def q_explorer_inputs(spark, sf):
    return rounded(X.explorer_inputs(_clusters(spark, sf), _rich(spark, sf)))


def _tree_sql(min_purity: float) -> str:
    return _exp(f""",
vis AS (SELECT * FROM stats WHERE purity >= {min_purity}),
cat AS (SELECT dominant_category AS category, CAST(sum(size) AS BIGINT) AS category_size FROM vis GROUP BY 1)
SELECT v.dominant_category AS category, v.cluster_id, 'Cluster ' || CAST(v.cluster_id AS VARCHAR) AS cluster_name,
       v.size, round(v.purity, 6) AS purity, c.category_size, m.name AS leaf_name, m.count AS leaf_count,
       m.percentage AS leaf_percentage
FROM vis v JOIN cat c ON c.category = v.dominant_category
LEFT JOIN comp m ON m.cluster_id = CAST(v.cluster_id AS VARCHAR)""").replace("\n,\nvis AS", ",\nvis AS")


def _fix(sql: str) -> str:
    # _EXP ends right after the last CTE; extra CTEs continue the WITH list
    return sql.replace(")\n,\nvis AS", "),\nvis AS")


@register("tree", _fix(_tree_sql(0.0)))
def q_tree(spark, sf):
    return rounded(X.tree(_clusters(spark, sf), _rich(spark, sf), 0.0))


@register("tree_filtered", _fix(_tree_sql(0.23)))
def q_tree_filtered(spark, sf):
    return rounded(X.tree(_clusters(spark, sf), _rich(spark, sf), 0.23))


@register("category_rollup", _exp("""
SELECT dominant_category AS category, count(*) AS n_clusters, CAST(sum(size) AS BIGINT) AS size FROM stats GROUP BY 1"""))
def q_category_rollup(spark, sf):
    return X.category_rollup(_clusters(spark, sf))


@register("explorer_stats", _exp("""
SELECT round((SELECT avg(purity) FROM stats), 6) AS mean_purity,
       count(DISTINCT dominant_category) AS n_categories, count(*) AS n_clusters
FROM stats WHERE purity >= 0.23"""))
def q_explorer_stats(spark, sf):
    return rounded(X.explorer_stats(_clusters(spark, sf), 0.23))


def _search_sql(term: str, min_purity: float = 0.0) -> str:
    return _fix(_exp(f""",
vis AS (SELECT * FROM stats WHERE purity >= {min_purity}),
hits AS (
  SELECT category, 0 AS sub, 'Category' AS type, category AS name
  FROM (SELECT DISTINCT dominant_category AS category FROM vis) WHERE contains(lower(category), '{term}')
  UNION ALL
  SELECT category, sub, 'Cluster', name FROM (
    SELECT dominant_category AS category, 'Cluster ' || CAST(cluster_id AS VARCHAR) AS name,
           row_number() OVER (PARTITION BY dominant_category ORDER BY cluster_id) AS sub
    FROM vis WHERE contains(lower('Cluster ' || CAST(cluster_id AS VARCHAR)), '{term}')
       OR contains(CAST(cluster_id AS VARCHAR), '{term}')) WHERE sub <= 5)
SELECT CAST(row_number() OVER (ORDER BY category, sub) AS BIGINT) AS pos, type, name
FROM (SELECT * FROM hits ORDER BY category, sub LIMIT 20)"""))


@register("explorer_search", _search_sql("ar"))
def q_explorer_search(spark, sf):
    return X.search(_clusters(spark, sf), "ar")


@register("explorer_search_clusters", _search_sql("r 1"))
def q_explorer_search_clusters(spark, sf):
    return X.search(_clusters(spark, sf), "r 1")


@register("node_lookup", _exp("""
SELECT 'cluster' AS type, 'Cluster ' || CAST(cluster_id AS VARCHAR) AS name, size, round(purity, 6) AS purity
FROM stats WHERE cluster_id = 3"""))
def q_node_lookup(spark, sf):
    return rounded(X.node_lookup(_clusters(spark, sf), cluster_id=3))


@register("cluster_details", _exp("""
SELECT cluster_id, rank, name, count, percentage, percentage > 40 AS major,
       round(least(percentage / 20.0, 1.5) + 0.75, 6) AS weight, round(greatest(percentage / 40.0, 0.4), 6) AS emphasis
FROM comp"""))
def q_cluster_details(spark, sf):
    return rounded(X.cluster_details(_rich(spark, sf)))
