"""Explorer datasets.

Inputs: the cluster table ``(cluster_id, size, purity, dominant_category)``
and the optional long composition ``(cluster_id, rank, name, count, percentage)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.text import cluster_node_name


def explorer_inputs(clusters: DataFrame, rich: DataFrame | None) -> DataFrame:
    """Clusters ⟕ composition (id matched as string); missing rich data → no leaves."""
    base = clusters.select("cluster_id", "size", "purity", "dominant_category",
                           F.col("cluster_id").cast("string").alias("_k"))
    if rich is None:
        return base.drop("_k").withColumn("n_leaves", F.lit(0).cast("long"))
    leaves = rich.groupBy(F.col("cluster_id").cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("n_leaves"))
    return (base.join(leaves, "_k", "left").drop("_k")
            .withColumn("n_leaves", F.coalesce("n_leaves", F.lit(0)).cast("long")))


def tree(clusters: DataFrame, rich: DataFrame | None = None, min_purity: float = 0.0) -> DataFrame:
    """U6 flattened (one row per leaf; clusters without leaves keep one row with null leaf).

    F6: clusters below ``min_purity`` are removed before grouping, so empty
    categories disappear. Category size = sum of its visible cluster sizes.
    """
    vis = clusters.filter(F.col("purity") >= min_purity)
    cat = vis.groupBy(F.col("dominant_category").alias("category")).agg(F.sum("size").alias("category_size"))
    nodes = vis.select(F.col("dominant_category").alias("category"), "cluster_id",
                       cluster_node_name("cluster_id").alias("cluster_name"), "size", "purity")
    out = nodes.join(cat, "category")
    if rich is not None:
        leaves = rich.select(F.col("cluster_id").cast("string").alias("_k"), F.col("name").alias("leaf_name"),
                             F.col("count").alias("leaf_count"), F.col("percentage").alias("leaf_percentage"))
        out = (out.withColumn("_k", F.col("cluster_id").cast("string")).join(leaves, "_k", "left").drop("_k"))
    return out


def tree_nested(clusters: DataFrame, rich: DataFrame | None = None, min_purity: float = 0.0) -> DataFrame:
    """U6 nested: one row per category with its clusters (by id) and their leaves (by rank) as arrays of structs."""
    vis = clusters.filter(F.col("purity") >= min_purity).withColumn("_k", F.col("cluster_id").cast("string"))
    leaf = "array<struct<name:string,count:bigint,percentage:double>>"
    if rich is None:
        vis = vis.withColumn("leaves", F.array().cast(leaf))
    else:
        per = rich.groupBy(F.col("cluster_id").cast("string").alias("_k")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "name", "count", "percentage"))).alias("l"))
        vis = vis.join(per, "_k", "left").withColumn("leaves", F.coalesce(F.transform("l", lambda x: F.struct(
            x["name"].alias("name"), x["count"].alias("count"), x["percentage"].alias("percentage"))).cast(leaf),
            F.array().cast(leaf)))
    child = F.struct("cluster_id", cluster_node_name("cluster_id").alias("name"), "size", "purity",
                     F.col("leaves").alias("children"))
    return vis.groupBy(F.col("dominant_category").alias("name")).agg(
        F.sum("size").alias("size"), F.sort_array(F.collect_list(child)).alias("children"))


def category_rollup(clusters: DataFrame, min_purity: float = 0.0) -> DataFrame:
    """Per dominant category the cluster count and size sum (after F6)."""
    vis = clusters.filter(F.col("purity") >= min_purity)
    return vis.groupBy(F.col("dominant_category").alias("category")).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("size"))


def explorer_stats(clusters: DataFrame, min_purity: float | None = None) -> DataFrame:
    """Categories, clusters and unweighted mean purity.

    With a filter, only the two counts follow the visible tree (mean purity
    stays the unfiltered value, as in the page header).
    """
    allp = clusters.agg(F.avg("purity").alias("mean_purity"),
                        F.count_distinct("dominant_category").alias("n_categories"),
                        F.count(F.lit(1)).alias("n_clusters"))
    if min_purity is None:
        return allp
    vis = clusters.filter(F.col("purity") >= min_purity).agg(
        F.count_distinct("dominant_category").alias("n_categories"), F.count(F.lit(1)).alias("n_clusters"))
    from taxolens.operators.metrics import join_single_rows
    return join_single_rows(allp.select("mean_purity"), vis)


def search(clusters: DataFrame, term: str, min_purity: float = 0.0, per_category: int = 5,
           limit: int = 20) -> DataFrame:
    """Case-insensitive search over the (filtered) tree.

    Categories ascending; for each, the category itself if its name matches,
    then up to ``per_category`` matching clusters (name or id contains the
    term), then the overall first ``limit`` results. Terms shorter than 2
    characters return nothing.
    """
    t = term.lower()
    vis = clusters.filter(F.col("purity") >= min_purity)
    if len(t) < 2:
        return vis.limit(0).select(F.lit(0).cast("long").alias("pos"), F.lit("").alias("type"),
                                   F.lit("").alias("name"))
    cats = vis.select(F.col("dominant_category").alias("category")).distinct()
    cat_hits = cats.filter(F.lower("category").contains(t)).select(
        "category", F.lit(0).alias("sub"), F.lit("Category").alias("type"), F.col("category").alias("name"))
    cl = vis.select(F.col("dominant_category").alias("category"), "cluster_id",
                    cluster_node_name("cluster_id").alias("name"))
    cl = cl.filter(F.lower("name").contains(t) | F.col("cluster_id").cast("string").contains(t))
    w = Window.partitionBy("category").orderBy("cluster_id")
    cl_hits = (cl.withColumn("sub", F.row_number().over(w)).filter(F.col("sub") <= per_category)
               .select("category", "sub", F.lit("Cluster").alias("type"), "name"))
    hits = cat_hits.unionByName(cl_hits).orderBy("category", "sub").limit(limit)
    w2 = Window.orderBy("category", "sub")  # ≤ limit rows after the ordered limit
    return hits.select(F.row_number().over(w2).cast("long").alias("pos"), "type", "name")


def node_lookup(clusters: DataFrame, cluster_id=None, category: str | None = None) -> DataFrame:
    """first cluster node with the id, or first category node with the name."""
    if cluster_id is not None:
        return (clusters.filter(F.col("cluster_id") == F.lit(cluster_id)).orderBy("cluster_id").limit(1)
                .select(F.lit("cluster").alias("type"), cluster_node_name("cluster_id").alias("name"),
                        "size", "purity"))
    cat = clusters.filter(F.col("dominant_category") == F.lit(category))
    return (cat.groupBy("dominant_category").agg(F.sum("size").alias("size"))
            .select(F.lit("category").alias("type"), F.col("dominant_category").alias("name"), "size",
                    F.lit(None).cast("double").alias("purity")))


def cluster_details(rich: DataFrame) -> DataFrame:
    """Composition items with significance columns, percentage descending."""
    p = F.col("percentage")
    return rich.select("cluster_id", "rank", "name", "count", "percentage",
                       (p > 40).alias("major"),
                       (F.least(p / 20.0, F.lit(1.5)) + 0.75).alias("weight"),
                       F.greatest(p / 40.0, F.lit(0.4)).alias("emphasis"))
