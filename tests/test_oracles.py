"""Spark queries vs their DuckDB oracle SQL on the smallest fixture (driver-style compare)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

FAST = ["clean_html", "decode_entities", "normalize_ws", "impute_text", "text_features", "rejection_rate",
        "sample_exact", "contingency", "crosstab_wide", "purity", "ari", "nmi", "fowlkes_mallows",
        "experiment_row", "cluster_stats", "cluster_stats_no_truth", "worst_clusters", "best_clusters",
        "quality_summary", "size_histogram", "size_distribution", "purity_histogram", "cluster_report", "cluster_report_split",
        "majority_label", "predict_majority", "misclassified_head", "confusion_matrix", "error_rate",
        "centroid_distance", "nearest_centroid", "lloyd_fixed", "silhouette", "davies_bouldin",
        "calinski_harabasz", "covariance", "representatives", "worst_clusters_analysis", "eps_join", "dbscan", "dbscan_cells", "dbscan_cells",
        "sankey_nodes", "sankey_flows", "flow_direction", "composition", "extract_embedded_links", "tree",
        "explorer_search_clusters", "majority_vote", "overlap_matrix", "coassociation", "consensus_mod_assign",
        "compute_metrics", "train_test_split", "core_distance", "mutual_reachability", "pairwise_distance",
        "load_products", "load_products_records", "load_products_columns", "best_runs", "explorer_stats", "category_rollup", "node_lookup", "cluster_details",
        "flow_indexed", "sample_labelings", "attach_labels", "top_categories", "quality_band", "misclassified",
        "accuracy", "label_set", "cluster_sizes", "dominant_category", "top2_gap", "top_label_counts",
        "category_counts", "category_nunique", "display_name", "embed_cache_missing", "source_shape", "preview",
        "noise_summary", "ward_summaries", "bisecting_totals", "birch_cf_totals", "homogeneity", "completeness", "v_measure", "centroids", "purity_bins10",
        "explorer_inputs", "tree_filtered", "explorer_search"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def test_every_query_has_unique_name():
    assert len(E.queries()) >= 90
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    con = duck(SF_SMALL)
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dk)
