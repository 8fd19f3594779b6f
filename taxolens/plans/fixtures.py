"""Derived fixtures built from the given tables (Spark side).

Each has a SQL twin in ``taxolens.plans.catalog.sqlfix`` so the DuckDB
oracle reads exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.sources.tables import read_table


def _src_number(col: str = "source"):
    return F.when(F.col(col) == "src0", F.lit(-1)).otherwise(
        F.substring(F.col(col), 4, 10).cast("int"))


def lab_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with cluster = source number (src0 → noise), truth = lang."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), _src_number().alias("cluster"),
                    F.col("lang").alias("true_label"), "text", "source", "n_chars")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rendered as product records with blanks, nulls and HTML."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("row_id"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.lit(""))
         .otherwise(F.col("p_name")).alias("Title"),
        F.when(k % 5 == 0, F.lit(" a ")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
         .alias("ProductName"),
        F.when(k % 35 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("Brand"),
        F.when(k % 385 == 0, F.lit(None).cast("string")).otherwise(F.concat(
            F.lit('<div class="d"><p>'), F.col("p_name"), F.lit(" &amp; size "),
            F.col("p_size").cast("string"),
            F.lit("</p><!-- c --><script>x()</script>\n<b>ok</b></div>"))).alias("Description"),
        F.lit(None).cast("string").alias("LongDesc"),
        F.col("p_type").alias("true_label"),
    )


def prod_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products with a labeling: cluster = brand number, brand 25 → noise."""
    p = products(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.substring("p_brand", 7, 10).cast("int").alias("bno"))
    return (p.join(part, "row_id")
            .withColumn("cluster", F.when(F.col("bno") == 25, F.lit(-1)).otherwise(F.col("bno")))
            .drop("bno"))


def labelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labelings of documents as a long table (algo, algo_ord, row_id, cluster)."""
    d = read_table(spark, sf_dir, "documents")
    src = d.select(F.lit("src").alias("algo"), F.lit(0).alias("algo_ord"),
                   F.col("doc_id").alias("row_id"), _src_number().alias("cluster"))
    mod = d.select(F.lit("mod").alias("algo"), F.lit(1).alias("algo_ord"),
                   F.col("doc_id").alias("row_id"),
                   F.when(F.col("doc_id") % 10 == 9, F.lit(-1))
                    .otherwise((F.col("doc_id") % 10).cast("int")).alias("cluster"))
    dec = d.select(F.lit("dec").alias("algo"), F.lit(2).alias("algo_ord"),
                   F.col("doc_id").alias("row_id"),
                   F.when(F.col("n_chars") < 200, F.lit(-1))
                    .otherwise(F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("int"))
                    .alias("cluster"))
    return src.unionByName(mod).unionByName(dec)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (row_id, features: array<double>, true_label)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("string").alias("true_label"))


def vec_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings paired with documents by id: vector, cluster = label, truth = lang, text.

    Both sides are dealt out by id: neither goes through the driver to be broadcast."""
    e = read_table(spark, sf_dir, "embeddings")
    d = read_table(spark, sf_dir, "documents").hint("merge")
    return (e.join(d, e["vec_id"] == d["doc_id"])
            .select(F.col("vec_id").alias("row_id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").alias("cluster"), F.col("lang").alias("true_label"), "text"))


def vec_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a labeling: features, cluster = label."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").alias("cluster"))


def flow_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with truth = source (20 categories) and cluster = doc_id % 10 (9 → noise)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("source").alias("true_label"),
                    F.when(F.col("doc_id") % 10 == 9, F.lit(-1))
                    .otherwise((F.col("doc_id") % 10).cast("int")).alias("cluster"))


VD_ALGOS = ["label", "src", "mod"]


def vd_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_doc rows (row_id, features, true_label) with a column for each of three labelings.

    Rows are joined by the same dealing as in ``vec_doc``."""
    v = vec_doc(spark, sf_dir)
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source")
    mod = F.col("row_id") % 10
    clusters = {"label": F.col("cluster").cast("int"), "src": _src_number(),
                "mod": F.when(mod == 9, F.lit(-1)).otherwise(mod.cast("int"))}
    return v.join(d.hint("merge"), "row_id").select("row_id", "features", "true_label",
                                                    *(clusters[a].alias(a) for a in VD_ALGOS))


def vd_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_doc rows under three labelings (algo, algo_ord, row_id, features, true_label, cluster).

    Rows are joined once, and each is written out for its labelings."""
    under = F.explode(F.array(*[F.struct(F.lit(a).alias("algo"), F.lit(i).alias("algo_ord"), F.col(a).alias("cluster"))
                                for i, a in enumerate(VD_ALGOS)])).alias("_l")
    return (vd_wide(spark, sf_dir).select("row_id", "features", "true_label", under)
            .select("_l.algo", "_l.algo_ord", "row_id", "features", "true_label", "_l.cluster"))
