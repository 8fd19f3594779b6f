"""Per-cluster reports and summaries.

All per-cluster work is ``groupBy`` with partial aggregation; "first seen"
and "smallest label" tie rules are encoded in struct orderings so no window
has to gather a whole cluster into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.operators.metrics import join_single_rows
from taxolens.schema import CLUSTER, NOISE, ROW_ID, TRUTH


def cluster_sizes(labeling: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    """A1: rows per cluster (noise included as -1)."""
    return labeling.groupBy(F.col(cluster).alias(CLUSTER)).agg(F.count(F.lit(1)).alias("size"))


def label_set(labeling: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    """Distinct cluster ids minus noise."""
    return labeling.select(F.col(cluster).alias(CLUSTER)).filter(F.col(CLUSTER) != NOISE).distinct()


def category_counts(df: DataFrame, truth: str = TRUTH) -> DataFrame:
    """A4: rows per category, nulls dropped (value_counts)."""
    return (df.filter(F.col(truth).isNotNull()).groupBy(F.col(truth).alias(TRUTH))
            .agg(F.count(F.lit(1)).alias("n")))


def top_categories(df: DataFrame, n: int, truth: str = TRUTH) -> DataFrame:
    """The n most frequent categories; ties by name ascending."""
    return category_counts(df, truth).orderBy(F.col("n").desc(), F.col(TRUTH)).limit(n)


def category_nunique(df: DataFrame, truth: str = TRUTH) -> DataFrame:
    """Distinct non-null categories."""
    return df.agg(F.count_distinct(truth).alias("n_categories"))


def _cells(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    return (df.groupBy(F.col(cluster).alias(CLUSTER), F.col(truth).alias(TRUTH))
            .agg(F.count(F.lit(1)).alias("n"), F.min(ROW_ID).alias("first_row")))


def dominant_category(df: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """Per cluster (noise omitted) the most common label, ties → first seen.

    Null labels count as a key. Output: cluster, size, dominant_category,
    dominant_count, num_categories.
    """
    cells = _cells(df.filter(F.col(cluster) != NOISE), truth, cluster)
    best = F.max(F.struct(F.col("n"), (-F.col("first_row")).alias("neg_first"), F.col(TRUTH)))
    return (cells.groupBy(CLUSTER)
            .agg(F.sum("n").alias("size"), best.alias("b"), F.count(F.lit(1)).alias("num_categories"))
            .select(CLUSTER, "size", F.col(f"b.{TRUTH}").alias("dominant_category"),
                    F.col("b.n").alias("dominant_count"), "num_categories"))


def majority_label(df: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER) -> DataFrame:
    """A5: per non-noise cluster the modal label; ties → smallest; all-null → 'Unknown'."""
    valid = df.filter(F.col(cluster) != NOISE)
    cells = (valid.filter(F.col(truth).isNotNull())
             .groupBy(F.col(cluster).alias(CLUSTER), F.col(truth).alias(TRUTH))
             .agg(F.count(F.lit(1)).alias("n")))
    mode = (cells.groupBy(CLUSTER)
            .agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col(TRUTH))).alias("m"))
            .select(CLUSTER, F.col(f"m.{TRUTH}").alias("majority_label")))
    clusters = valid.select(F.col(cluster).alias(CLUSTER)).distinct()
    return (clusters.join(mode, CLUSTER, "left")
            .select(CLUSTER, F.coalesce("majority_label", F.lit("Unknown")).alias("majority_label")))


def cluster_stats(df: DataFrame, truth: str | None = TRUTH, cluster: str = CLUSTER,
                  sort: bool = False) -> DataFrame:
    """cluster_id, size, pct (of all rows incl. noise) [, dominant_category, purity, num_categories].

    ``sort=True`` gives the report order (L4): purity ascending, ties by id; by id without truth.
    """
    out = _cluster_stats(df, truth, cluster)
    if sort:
        out = out.orderBy(*(["purity", "cluster_id"] if truth else ["cluster_id"]))
    return out


def _cluster_stats(df: DataFrame, truth: str | None, cluster: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    if truth is None:
        sizes = (df.filter(F.col(cluster) != NOISE).groupBy(F.col(cluster).alias("cluster_id"))
                 .agg(F.count(F.lit(1)).alias("size")))
        out = join_single_rows(sizes, total)
        return out.select("cluster_id", "size", (F.col("size") * 100.0 / F.col("_total")).alias("pct"))
    dom = dominant_category(df, truth, cluster)
    out = join_single_rows(dom, total)
    return out.select(F.col(CLUSTER).alias("cluster_id"), "size",
                      (F.col("size") * 100.0 / F.col("_total")).alias("pct"),
                      "dominant_category",
                      (F.col("dominant_count") / F.col("size")).alias("purity"),
                      "num_categories")


def worst_clusters(stats: DataFrame, n: int = 10) -> DataFrame:
    """L1: lowest purity; ties by cluster id; without purity the first n by id."""
    if "purity" not in stats.columns:
        return stats.orderBy("cluster_id").limit(n)
    return stats.orderBy(F.col("purity"), F.col("cluster_id")).limit(n)


def best_clusters(stats: DataFrame, n: int = 10) -> DataFrame:
    """L2: highest purity; ties by cluster id; without purity the last n by id."""
    if "purity" not in stats.columns:
        return stats.orderBy(F.col("cluster_id").desc()).limit(n)
    return stats.orderBy(F.col("purity").desc(), F.col("cluster_id")).limit(n)


def quality_summary(stats: DataFrame) -> DataFrame:
    """Size and purity summary over the per-cluster stats table."""
    aggs = [F.count(F.lit(1)).alias("total_clusters"),
            F.median("size").alias("median_size"), F.avg("size").alias("mean_size"),
            F.min("size").alias("min_size"), F.max("size").alias("max_size")]
    if "purity" in stats.columns:
        aggs += [F.median("purity").alias("median_purity"), F.avg("purity").alias("mean_purity"),
                 F.count(F.when(F.col("purity") >= 0.9, 1)).alias("clusters_above_90pct"),
                 F.count(F.when(F.col("purity") < 0.5, 1)).alias("clusters_below_50pct")]
    return stats.agg(*aggs)


def equal_width_histogram(values: DataFrame, col: str, bins: int) -> DataFrame:
    """Numpy-style equal-width bins over [min, max], last bin right-closed.

    Zero-filled: every bin 0..bins-1 appears. A constant column uses the
    range [v-0.5, v+0.5] like numpy.
    """
    rng = values.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx"))
    rng = rng.select(
        F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = join_single_rows(values.select(F.col(col).cast("double").alias("v")), rng).select(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def size_histogram(labeling: DataFrame, bins: int = 50, cluster: str = CLUSTER) -> DataFrame:
    """Histogram of non-noise cluster sizes."""
    sizes = cluster_sizes(labeling.filter(F.col(cluster) != NOISE), cluster)
    return equal_width_histogram(sizes, "size", bins)


def size_distribution(labeling: DataFrame, bins: int = 50, cluster: str = CLUSTER) -> DataFrame:
    """Both views of the cluster sizes: the histogram, the log10 of its edges, and the median and mean marked in it."""
    sizes = cluster_sizes(labeling.filter(F.col(cluster) != NOISE), cluster)
    marks = sizes.agg(F.median("size").alias("median_size"), F.avg("size").alias("mean_size"))
    out = equal_width_histogram(sizes, "size", bins)
    # edges are at least 0.5
    out = out.select("bin", "bin_lo", "bin_hi", F.log10("bin_lo").alias("log_lo"), F.log10("bin_hi").alias("log_hi"), "count")
    return join_single_rows(out, marks)


def purity_histogram(stats: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of per-cluster purity."""
    return equal_width_histogram(stats, "purity", bins)


def purity_bins10(stats: DataFrame) -> DataFrame:
    """Explorer purity chart, bin = min(floor(p*10), 9), zero-filled."""
    binned = stats.select(F.least(F.floor(F.col("purity") * 10), F.lit(9)).cast("int").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("clusters"))
    grid = stats.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", F.coalesce("clusters", F.lit(0)).cast("long").alias("clusters")))


def cluster_report(df: DataFrame, truth: str = TRUTH, cluster: str = CLUSTER,
                   split_by_label: bool = False) -> DataFrame:
    """Dominant + second label, purity, top-2 gap, label counts.

    Noise rows are excluded. ``split_by_label`` groups by (cluster, label)
    with id ``{cluster}__{label}``. Label order: count desc, name asc.
    """
    valid = df.filter((F.col(cluster) != NOISE) & F.col(truth).isNotNull())
    cells = (valid.groupBy(F.col(cluster).alias(CLUSTER), F.col(truth).alias(TRUTH))
             .agg(F.count(F.lit(1)).alias("n")))
    if split_by_label:
        cells = cells.select(F.concat_ws("__", F.col(CLUSTER).cast("string"), F.col(TRUTH)).alias(CLUSTER),
                             TRUTH, "n")
    item = F.struct((-F.col("n")).alias("neg_n"), F.col(TRUTH).alias("name"), F.col("n").alias("n"))
    grouped = cells.groupBy(CLUSTER).agg(F.sum("n").alias("size"),
                                         F.sort_array(F.collect_list(item)).alias("items"))
    first, second = F.col("items")[0], F.get(F.col("items"), 1)
    counts = F.array_join(F.transform("items", lambda x: F.concat(x["name"], F.lit(":"),
                                                                  x["n"].cast("string"))), "; ")
    return grouped.select(
        F.col(CLUSTER).cast("string").alias("cluster_id"), "size",
        first["name"].alias("dominant_L3"), first["n"].alias("dominant_count"),
        second["name"].alias("second_L3"),
        F.coalesce(second["n"], F.lit(0)).cast("long").alias("second_count"),
        (first["n"] / F.col("size")).alias("purity"),
        ((first["n"] - F.coalesce(second["n"], F.lit(0))) / F.col("size")).alias("top2_gap"),
        counts.alias("top_L3_counts"))


def cluster_quality_report(df: DataFrame, vectors: DataFrame | None = None, features: str = "features",
                           truth: str | None = TRUTH, cluster: str = CLUSTER, n_worst: int = 10):
    """(stats, summary, size histogram, purity histogram, worst-cluster analysis).

    Without truth the purity parts are None (the reference's print fails there).
    """
    stats = cluster_stats(df, truth, cluster)
    summary = quality_summary(stats)
    sizes = size_histogram(df, 50, cluster)
    purity = purity_histogram(stats, 20) if truth else None
    worst = None
    if vectors is not None and truth:
        from taxolens.plans.catalog.q_vectors import worst_clusters_analysis
        worst = worst_clusters_analysis(df.join(vectors.select(ROW_ID, features), ROW_ID), n_worst)
    return stats, summary, sizes, purity, worst
