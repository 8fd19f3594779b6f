"""Label ensembles (E1-E6) over the long labelings table
``(algo, algo_ord, row_id, cluster)``; ``algo_ord`` 0 is the alignment reference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.operators.assignment import max_weight_matching
from taxolens.operators.metrics import join_single_rows
from taxolens.operators.neighbors import connected_components, dense_index
from taxolens.session import cut_lineage
from taxolens.schema import NOISE, ROW_ID


# ------------------------------------------------------------------ E5 voting

def majority_vote(labelings: DataFrame) -> DataFrame:
    """E5: per row the most frequent non-noise label; ties → the label met first in
    algorithm order; rows with no non-noise vote → -1. Pure ``groupBy`` (no windows)."""
    votes = (labelings.filter(F.col("cluster") != NOISE)
             .groupBy(ROW_ID, "cluster")
             .agg(F.count(F.lit(1)).alias("n"), F.min("algo_ord").alias("first_ord")))
    best = (votes.groupBy(ROW_ID)
            .agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("first_ord"), F.col("cluster"))).alias("b"))
            .select(ROW_ID, F.col("b.cluster").alias("vote")))
    rows = labelings.select(ROW_ID).distinct()
    return (rows.join(best, ROW_ID, "left")
            .select(ROW_ID, F.coalesce("vote", F.lit(NOISE)).cast("int").alias("cluster")))


# ----------------------------------------------------------------- E4 alignment

def overlap_matrix(labelings: DataFrame, ref_ord: int = 0) -> DataFrame:
    """Sparse overlap ``(algo, ref_cluster, cluster, n)`` of every labeling with the
    reference, over rows that are non-noise in both."""
    ref = labelings.filter(F.col("algo_ord") == ref_ord).select(ROW_ID, F.col("cluster").alias("ref_cluster"))
    other = labelings.filter(F.col("algo_ord") != ref_ord)
    j = other.join(ref, ROW_ID).filter((F.col("cluster") != NOISE) & (F.col("ref_cluster") != NOISE))
    return j.groupBy("algo", "ref_cluster", "cluster").agg(F.count(F.lit(1)).alias("n"))


def _solve_component(pdf: pd.DataFrame) -> pd.DataFrame:
    refs = np.sort(pdf["ref_cluster"].unique())
    labs = np.sort(pdf["cluster"].unique())
    ri = {v: i for i, v in enumerate(refs)}
    li = {v: i for i, v in enumerate(labs)}
    w = np.zeros((len(labs), len(refs)))
    for r, c, n in zip(pdf["ref_cluster"], pdf["cluster"], pdf["n"]):
        w[li[c], ri[r]] = n
    match = max_weight_matching(w)
    keep = match >= 0
    return pd.DataFrame({"algo": pdf["algo"].iloc[0], "cluster": labs[keep].astype(np.int64),
                         "new": refs[match[keep]].astype(np.int64)})


def alignment_map(labelings: DataFrame, ref_ord: int = 0) -> DataFrame:
    """E4 mapping ``(algo, cluster, new)`` — a bijection on 0..max_label-1 per algorithm.

    Overlaps split into connected components of the bipartite overlap graph;
    each component is solved independently (its matrix is #ref × #lab of that
    component, not k²). Labels left unmatched take the unused reference ids in
    ascending order. Tie-breaking may differ from other solvers.
    """
    ov = overlap_matrix(labelings, ref_ord).persist()
    nodes = ov.select("algo", "ref_cluster", "cluster", "n",
                      F.concat_ws(":", "algo", F.lit("r"), F.col("ref_cluster").cast("string")).alias("rn"),
                      F.concat_ws(":", "algo", F.lit("l"), F.col("cluster").cast("string")).alias("ln"))
    ids = dense_index(nodes.select(F.col("rn").alias("name")).unionByName(nodes.select(F.col("ln").alias("name"))),
                      "name", "nid")
    e = (nodes.join(ids.withColumnRenamed("name", "rn").withColumnRenamed("nid", "src"), "rn")
         .join(ids.withColumnRenamed("name", "ln").withColumnRenamed("nid", "dst"), "ln"))
    comps = connected_components(e.select("src", "dst"))
    cells = e.join(comps.withColumnRenamed("node", "src"), "src").select("algo", "ref_cluster", "cluster", "n", "comp")
    matched = cells.groupBy("comp").applyInPandas(_solve_component, "algo string, cluster long, new long")
    # bijection completion: unmatched labels → unused ids, both ascending
    per_algo_max = (labelings.filter(F.col("cluster") != NOISE).groupBy("algo")
                    .agg(F.max("cluster").alias("mx")))
    ref_max = labelings.filter((F.col("algo_ord") == ref_ord) & (F.col("cluster") != NOISE)).agg(
        F.max("cluster").alias("rmx"))
    bound = join_single_rows(per_algo_max, ref_max).select("algo", (F.greatest("mx", "rmx") + 1).alias("size"))
    space = bound.select("algo", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("v"))
    # a labeling that shares no row with the reference has no overlap cell and stays as it is
    present = labelings.filter((F.col("algo_ord") != ref_ord) & (F.col("cluster") != NOISE)).select(
        "algo", F.col("cluster").cast("long").alias("cluster")).distinct().join(
        ov.select("algo").distinct(), "algo", "left_semi")
    um = present.join(matched.select("algo", "cluster"), ["algo", "cluster"], "left_anti")
    unused = space.join(matched.select("algo", F.col("new").alias("v")), ["algo", "v"], "left_anti")
    w1 = Window.partitionBy("algo").orderBy("cluster")
    w2 = Window.partitionBy("algo").orderBy("v")
    # ranks within an algorithm's label space (bounded by its cluster count)
    fill = (um.withColumn("k", F.row_number().over(w1))
            .join(unused.withColumn("k", F.row_number().over(w2)), ["algo", "k"])
            .select("algo", "cluster", F.col("v").alias("new")))
    return matched.unionByName(fill)


def align_labels(labelings: DataFrame, ref_ord: int = 0) -> DataFrame:
    """Relabel every non-reference labeling onto the reference ids; noise stays -1.
    A labeling with no non-noise overlap is left unchanged."""
    m = alignment_map(labelings, ref_ord)
    aligned = (labelings.join(m, ["algo", "cluster"], "left")
               .withColumn("cluster", F.when((F.col("algo_ord") == ref_ord) | (F.col("cluster") == NOISE),
                                             F.col("cluster"))
                           .otherwise(F.coalesce(F.col("new").cast("int"), F.col("cluster"))))
               .drop("new"))
    return aligned.select("algo", "algo_ord", ROW_ID, "cluster")


def voting_ensemble(labelings: DataFrame) -> DataFrame:
    """E5 as run by the reference: align to the first labeling, then majority vote."""
    return majority_vote(align_labels(labelings))


# --------------------------------------------------------- E1/E2/E3 co-association

def label_tuples(labelings: DataFrame) -> DataFrame:
    """Rows with the same label tuple have identical co-association to every other row:
    collapse to ``(tuple_key, labels array ordered by algo_ord, weight)``."""
    per_row = (labelings.groupBy(ROW_ID)
               .agg(F.sort_array(F.collect_list(F.struct("algo_ord", "cluster"))).alias("t"))
               .select(ROW_ID, F.col("t.cluster").alias("labels")))
    return per_row.groupBy("labels").agg(F.count(F.lit(1)).alias("weight"), F.min(ROW_ID).alias("first_row"))


def coassociation_summary(labelings: DataFrame) -> DataFrame:
    """E1 without pair enumeration: per label tuple its weight and the mean
    co-association of one of its rows with all other rows:
    Σ_algo [label ≠ -1]·(|cluster| − 1) / (n_algos · (N − 1))."""
    n_algos = labelings.select("algo").distinct().count()
    n_rows = labelings.select(ROW_ID).distinct().count()
    sizes = (labelings.filter(F.col("cluster") != NOISE).groupBy("algo", "cluster")
             .agg(F.count(F.lit(1)).alias("sz")))
    per_row = (labelings.join(sizes, ["algo", "cluster"], "left")
               .groupBy(ROW_ID).agg(F.sum(F.coalesce(F.col("sz") - 1, F.lit(0))).alias("co")))
    tup = (labelings.groupBy(ROW_ID)
           .agg(F.sort_array(F.collect_list(F.struct("algo_ord", "cluster"))).alias("t"))
           .select(ROW_ID, F.concat_ws("|", F.col("t.cluster").cast("array<string>")).alias("tuple_key")))
    return (tup.join(per_row, ROW_ID).groupBy("tuple_key")
            .agg(F.count(F.lit(1)).alias("weight"), F.first("co").alias("co"))
            .select("tuple_key", "weight",
                    (F.col("co") / (n_algos * max(1, n_rows - 1))).alias("mean_coassociation")))


def consensus(labelings: DataFrame, min_agree: int | None = None) -> DataFrame:
    """Rows that at least ``min_agree`` of the m labelings put together (default: more than half) share a cluster.

    The agreement graph's components, in place of a linkage over an N×N matrix: two rows agree in j labelings if and
    only if they share a j-subset of (labeling, cluster) pairs, noise left out, so every distinct label tuple sends
    one key per j-subset, each key links its tuples to the least one, and components close the links. A tuple's key
    count is a binomial in the number of labelings, whatever the number of rows. Rows that are noise in more than
    m - j labelings agree with none and are clusters of their own. Clusters are numbered by their least row id.
    """
    m = labelings.select("algo_ord").distinct().count()
    j = min_agree if min_agree is not None else m // 2 + 1
    if not 1 <= j <= max(m, 1):
        raise ValueError(f"min_agree must be from 1 to {m}, got {j}")
    per_row = (labelings.groupBy(ROW_ID)
               .agg(F.sort_array(F.collect_list(F.struct("algo_ord", "cluster"))).alias("t")))
    tuples = cut_lineage(per_row.groupBy("t").agg(F.min(ROW_ID).alias("node")))
    known = F.filter("t", lambda x: x["cluster"] != NOISE)
    subsets = F.array(F.array().cast("array<struct<algo_ord:int,cluster:int>>"))
    for _ in range(j):
        # longer subsets, each in the order of the labelings
        subsets = F.flatten(F.transform(subsets, lambda s: F.transform(
            F.filter("known", lambda x: (F.size(s) == 0) | (x["algo_ord"] > F.element_at(s, -1)["algo_ord"])),
            lambda x: F.concat(s, F.array(x)))))
    keys = (tuples.select("node", F.transform(known, lambda x: F.struct(
        x["algo_ord"].cast("int").alias("algo_ord"), x["cluster"].cast("int").alias("cluster"))).alias("known"))
            .filter(F.size("known") >= j).select("node", F.explode(subsets).alias("key")))
    heads = cut_lineage(keys.groupBy("key").agg(F.min("node").alias("dst")))
    comps = connected_components(keys.join(heads, "key").select(F.col("node").alias("src"), "dst"))
    of_tuple = (tuples.join(comps.withColumnRenamed("comp", "c"), "node").select("t", "c"))
    group = per_row.join(of_tuple, "t", "left").select(ROW_ID, F.coalesce("c", ROW_ID).alias("first_row"))
    group = cut_lineage(group)
    num = dense_index(group.select("first_row").distinct(), "first_row", "cluster")
    return group.join(num, "first_row").select(ROW_ID, F.col("cluster").cast("int").alias("cluster"))


def consensus_mod_assign(labelings: DataFrame, n_clusters: int) -> DataFrame:
    """E3 remainder rule: majority of raw (unaligned) non-noise labels mod n_clusters; none → -1."""
    v = majority_vote(labelings)
    return v.select(ROW_ID, F.when(F.col("cluster") == NOISE, F.lit(NOISE))
                    .otherwise(F.pmod("cluster", F.lit(n_clusters))).cast("int").alias("cluster"))


def run_ensemble(labelings: DataFrame, method: str = "consensus", min_agree: int | None = None) -> DataFrame:
    """E6 dispatch; unknown method → ValueError."""
    if method == "consensus":
        return consensus(labelings, min_agree)
    if method == "voting":
        return voting_ensemble(labelings)
    raise ValueError(f"Unknown method: {method}")
