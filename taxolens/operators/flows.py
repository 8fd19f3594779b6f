"""Category → cluster flows (A9, R13), node indexing (J3, U2), composition rollup (A10),
node-name parsing (P12) and the embedded-array payload scan (S8, R14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolens.functions.text import cluster_id_from_name, cluster_node_name
from taxolens.operators.neighbors import dense_index
from taxolens.operators.reports import top_categories
from taxolens.schema import CLUSTER, TRUTH


def flow_subset(df: DataFrame, top_n: int = 15, truth: str = TRUTH) -> DataFrame:
    """Rows whose category is among the top-n (ties by name); the list is ≤ top_n rows."""
    top = top_categories(df, top_n, truth).select(F.col(TRUTH).alias(truth))
    return df.join(F.broadcast(top), truth, "left_semi")


def flow_items(df: DataFrame, top_n: int | None = None, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """``(cluster_id, category, count)`` of all flows; ``top_n`` keeps those of the largest categories only."""
    rows = df.filter(F.col(truth).isNotNull()) if top_n is None else flow_subset(df, top_n, truth)
    return (rows.groupBy(F.col(cluster).cast("string").alias("cluster_id"), F.col(truth).alias("category"))
            .agg(F.count(F.lit(1)).alias("count")))


def sankey(sub: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> tuple[DataFrame, DataFrame]:
    """A9 + U2 together: (nodes, flows) sharing one pair of dense indices."""
    t_idx = dense_index(sub, truth, "source").persist()
    c_idx = dense_index(sub, cluster, "_ci").persist()
    n_t = t_idx.count()
    nodes = t_idx.select(F.col("source").alias("idx"), F.col(truth).alias("name"), F.lit("category").alias("kind")) \
        .unionByName(c_idx.select((F.col("_ci") + n_t).alias("idx"), cluster_node_name(cluster).alias("name"),
                                  F.lit("cluster").alias("kind")))
    flows = (sub.groupBy(truth, cluster).agg(F.count(F.lit(1)).alias("value"))
             .join(F.broadcast(t_idx), truth).join(c_idx, cluster)
             .select("source", (F.col("_ci") + n_t).alias("target"), "value",
                     F.col(truth).alias(TRUTH), F.col(cluster).alias(CLUSTER)))
    return nodes, flows


def sankey_nodes(sub: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """Node list = sorted categories then ``Cluster {c}`` for sorted clusters."""
    t_idx = dense_index(sub, truth, "idx").select(F.col("idx"), F.col(truth).alias("name"),
                                                  F.lit("category").alias("kind"))
    n_t = t_idx.count()
    c_idx = dense_index(sub, cluster, "idx")
    c_nodes = c_idx.select((F.col("idx") + n_t).alias("idx"), cluster_node_name(cluster).alias("name"),
                           F.lit("cluster").alias("kind"))
    return t_idx.unionByName(c_nodes)


def sankey_flows(sub: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """``(source, target, value)`` with node indices as in ``sankey_nodes``."""
    t_idx = dense_index(sub, truth, "source")
    n_t = t_idx.count()
    c_idx = dense_index(sub, cluster, "_ci")
    flows = sub.groupBy(truth, cluster).agg(F.count(F.lit(1)).alias("value"))
    return (flows.join(F.broadcast(t_idx), truth).join(c_idx, cluster)
            .select("source", (F.col("_ci") + n_t).alias("target"), "value",
                    F.col(truth).alias(TRUTH), F.col(cluster).alias(CLUSTER)))


def parse_flow_names(links: DataFrame, src: str = "source_name", tgt: str = "target_name",
                     value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Keep category→cluster or cluster→category links, drop mixed ones."""
    s_c = F.col(src).contains("Cluster")
    t_c = F.col(tgt).contains("Cluster")
    fwd = t_c & ~s_c
    rev = s_c & ~t_c
    return (links.filter(fwd | rev)
            .select(*(keep or []), F.when(fwd, cluster_id_from_name(tgt)).otherwise(cluster_id_from_name(src)).alias("cluster_id"),
                    F.when(fwd, F.col(src)).otherwise(F.col(tgt)).alias("category"),
                    F.col(value).alias("count")))


def composition(items: DataFrame, cluster: str = "cluster_id", name: str = "category",
                count: str = "count") -> DataFrame:
    """A10 (long): per cluster its categories by count desc (ties by name), percentage
    (1 decimal, half-even), total, purity and dominant category.

    One ``groupBy`` per cluster over its category list (≤ #categories items).
    """
    item = F.struct((-F.col(count)).alias("neg"), F.col(name).alias("name"), F.col(count).alias("count"))
    g = items.groupBy(cluster).agg(F.sort_array(F.collect_list(item)).alias("items"),
                                   F.sum(count).alias("total_size"))
    ex = g.select(cluster, "total_size", F.col("items")[0]["name"].alias("dominant_category"),
                  (F.col("items")[0]["count"] / F.col("total_size")).alias("purity"),
                  F.posexplode("items").alias("pos", "it"))
    return ex.select(cluster, (F.col("pos") + 1).cast("long").alias("rank"), F.col("it.name").alias("name"),
                     F.col("it.count").alias("count"),
                     F.bround(F.col("it.count") * 100.0 / F.col("total_size"), 1).alias("percentage"),
                     "total_size", "purity", "dominant_category")


def composition_nested(items: DataFrame, **kw) -> DataFrame:
    """A10/S7 nested: one row per cluster with ``breakdown: array<struct<name,count,percentage>>``."""
    long = composition(items, **kw)
    key = kw.get("cluster", "cluster_id")
    return (long.groupBy(key, "total_size", "purity", "dominant_category")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "name", "count", "percentage"))).alias("_b"))
            .select(key, F.transform("_b", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"),
                                                              x["percentage"].alias("percentage"))).alias("breakdown"),
                    "total_size", "purity", "dominant_category"))


# ---------------------------------------------------------------- S8 payload pages

def flow_payload(nodes: DataFrame, flows: DataFrame, page_key: str) -> DataFrame:
    """Render each group's flows as a page holding the four JSON arrays (the R13 output)."""
    lab = (nodes.groupBy(page_key)
           .agg(F.to_json(F.sort_array(F.collect_list(F.struct("idx", "name"))).getField("name")).alias("labels")))
    lk = (flows.groupBy(page_key)
          .agg(F.sort_array(F.collect_list(F.struct("source", "target", "value"))).alias("l")))
    lk = lk.select(page_key, F.to_json(F.col("l.source")).alias("s"), F.to_json(F.col("l.target")).alias("t"),
                   F.to_json(F.col("l.value")).alias("v"))
    page = lab.join(lk, page_key).select(page_key, F.concat(
        F.lit('<html><body><div id="g"></div><script>Plotly.newPlot("g", [{"type": "sankey", "node": {"pad": 15, "label": '),
        F.col("labels"), F.lit('}, "link": {"source": '), F.col("s"), F.lit(', "target": '), F.col("t"),
        F.lit(', "value": '), F.col("v"), F.lit("}}]);</script></body></html>")).alias("html"))
    return page


def _arr(name: str) -> F.Column:
    # the first array of that name; a bracket inside a string does not end it
    items = r"""[^\]"]*+(?:"(?:[^"\\]++|\\.)*+"[^\]"]*+)*+"""
    return F.regexp_extract(F.col("html"), f'"{name}"\\s*:\\s*(\\[{items}\\])', 1)


def extract_embedded_links(pages: DataFrame, page_key: str) -> DataFrame:
    """Parse the first label/source/target/value arrays of each page and
    resolve link indices to node names. Pages missing any array are skipped."""
    arrs = pages.select(page_key,
                        F.from_json(F.nullif(_arr("label"), F.lit("")), T.ArrayType(T.StringType())).alias("label"),
                        F.from_json(F.nullif(_arr("source"), F.lit("")), T.ArrayType(T.LongType())).alias("source"),
                        F.from_json(F.nullif(_arr("target"), F.lit("")), T.ArrayType(T.LongType())).alias("target"),
                        F.from_json(F.nullif(_arr("value"), F.lit("")), T.ArrayType(T.DoubleType())).alias("value"))
    arrs = arrs.filter(F.col("label").isNotNull() & F.col("source").isNotNull()
                       & F.col("target").isNotNull() & F.col("value").isNotNull())
    links = arrs.select(page_key, "label", F.posexplode(F.arrays_zip("source", "target", "value")).alias("pos", "z"))
    named = links.select(page_key, "pos",
                         F.try_element_at("label", F.greatest(F.col("z.source") + 1, F.lit(1)).cast("int")).alias("source_name"),
                         F.try_element_at("label", F.greatest(F.col("z.target") + 1, F.lit(1)).cast("int")).alias("target_name"),
                         F.col("z.value").alias("value"))
    return parse_flow_names(named, keep=[page_key, "pos"])
