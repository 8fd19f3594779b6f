"""End-to-end runs built from the operators (T4 and the smoke-entry flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.functions.text import clean_html
from taxolens.operators.clustering.kmeans import kmeans
from taxolens.operators.embed import embed_text
from taxolens.operators.reports import cluster_stats
from taxolens.operators.vectors import pca, silhouettes
from taxolens.session import cut_lineage
from taxolens.sources.tables import read_table, spread


def page_language(html_col: str = "html"):
    """Truth for pages: the ``<html lang="..">`` attribute."""
    return F.regexp_extract(F.col(html_col), r'(?i)<html[^>]*\blang="([^"]+)"', 1)


def flagship(spark: SparkSession, sf_dir: str, k: int = 4, dims: int = 16) -> DataFrame:
    """pages → clean HTML → TF-IDF → centred PCA → k-means → per-cluster stats vs language."""
    pages = read_table(spark, sf_dir, "pages")
    docs = pages.select(F.col("page_id").alias("row_id"), clean_html("html").alias("cluster_text"),
                        page_language().alias("true_label"))
    vecs = embed_text(docs, "cluster_text", num_features=512)
    red = pca(vecs, dims, out="reduced")
    labels = kmeans(red.select("row_id", "reduced"), n_clusters=k, n_init=3, features="reduced")
    joined = docs.join(labels, "row_id")
    return cluster_stats(joined)


DEFAULT_GRIDS = {
    "MiniBatchKMeans": {"n_clusters": [4, 8], "batch_size": [256]},
    "BisectingKMeans": {"n_clusters": [4, 8]},
    "BIRCH": {"threshold": [0.3, 0.5], "n_clusters": [None]},
}


def shared_silhouettes(vecs: DataFrame, labelings: list[DataFrame]) -> DataFrame | None:
    """Silhouettes ``s0``, ``s1``, ... of labelings ``(row_id, cluster)`` of the same rows, whose pairs are compared once.

    None if a row id repeats: joined to a labeling its rows multiply, for each labeling by itself."""
    ids = vecs.filter("row_id is not null")
    for labels in [vecs, *labelings]:
        n = labels.filter("row_id is not null").agg(F.count("row_id").alias("n"), F.count_distinct("row_id").alias("d")).first()
        if n["n"] != n["d"]:
            return None
    for i, labels in enumerate(labelings):
        ids = ids.join(labels.select("row_id", F.col("cluster").alias(f"s{i}")), "row_id", "left")
    return cut_lineage(silhouettes(cut_lineage(ids), [f"s{i}" for i in range(len(labelings))]))


def run_analysis(products: DataFrame, dims: int = 8, grids: dict | None = None, sample_size: int | None = None,
                 num_features: int = 512) -> dict[str, DataFrame]:
    """T4: features → embeddings → PCA → tune + fit each algorithm → metrics → voting
    ensemble → supervised control → comparison report → quality report of the best model.

    Returns the named result DataFrames (the CLI's CSV/HTML outputs as data).
    """
    from taxolens.operators.clustering.registry import run_algorithm
    from taxolens.operators.ensemble import voting_ensemble
    from taxolens.operators.evaluation import best_model, compute_metrics, metrics_long, results_table
    from taxolens.operators.features import create_text_features
    from taxolens.operators.flows import flow_subset, sankey_flows
    from taxolens.operators.reports import cluster_quality_report
    from taxolens.operators.supervised import run_baseline
    from taxolens.operators.tuning import require_params, tune_hyperparameters

    grids = grids or DEFAULT_GRIDS
    # every step after this one reads rows as they are dealt here
    feats = cut_lineage(create_text_features(spread(products)))
    vecs = pca(embed_text(feats, "cluster_text", num_features=num_features), dims, out="reduced")
    vecs = cut_lineage(vecs.select("row_id", "true_label", F.col("reduced").alias("features")))
    records, fits, params = {}, {}, {}
    for algo, grid in grids.items():
        params[algo], _, _ = tune_hyperparameters(vecs, algo, grid, sample_size)
        fits[algo] = cut_lineage(run_algorithm(algo, vecs, **require_params(params[algo])))
    all_lab = None
    for i, (algo, labels) in enumerate(fits.items()):
        one = labels.select(F.lit(algo).alias("algo"), F.lit(i).alias("algo_ord"), "row_id", "cluster")
        all_lab = one if all_lab is None else all_lab.unionByName(one)
    ens = cut_lineage(voting_ensemble(all_lab))
    scores = shared_silhouettes(vecs, [*fits.values(), ens]) if sample_size is None else None
    for i, (algo, labels) in enumerate([*fits.items(), ("Ensemble (Voting)", ens)]):
        score = None if scores is None else scores.select(F.col(f"s{i}").alias("silhouette"))
        rec = compute_metrics(vecs.join(labels, "row_id"), silhouette_sample=sample_size, score=score)
        records[algo] = cut_lineage(rec.withColumn("best_params", F.lit(str(params[algo]))) if algo in params else rec)
    base, _ = run_baseline(vecs)
    records["Supervised Baseline"] = cut_lineage(base)
    report = cut_lineage(results_table(records))
    clustering = [a for a in records if a != "Supervised Baseline"]
    best = best_model(report, clustering).first()["algorithm"]
    best_lab = ens if best == "Ensemble (Voting)" else all_lab.filter(F.col("algo") == best).select("row_id", "cluster")
    labeled_best = feats.select("row_id", "true_label", F.col("cluster_text").alias("text")).join(best_lab, "row_id")
    stats, summary, sizes, purity, worst = cluster_quality_report(labeled_best, vecs)
    return {"features": feats, "vectors": vecs, "labelings": all_lab, "ensemble": ens, "report": report,
            "metrics_long": metrics_long(report), "cluster_stats": stats, "summary": summary,
            "size_histogram": sizes, "purity_histogram": purity, "worst_clusters": worst,
            "sankey_flows": sankey_flows(flow_subset(labeled_best))}
