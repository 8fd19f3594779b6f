"""Expected values written by hand: text cleaning, JSON sources, payload pages, ensembles."""

import json

import pytest
from pyspark.sql import functions as F

from taxolens.functions import text as T
from taxolens.operators import ensemble as EN
from taxolens.operators import explorer as X
from taxolens.operators import flows as FL
from taxolens.operators.clustering import birch as B
from taxolens.sources.cache import refresh_cache
from taxolens.sources.json_source import load_products


@pytest.mark.parametrize("raw,want", [
    ("Caf&eacute; 5 &euro; &#8364; &#x20AC; &trade;", "Café 5 € € € ™"),
    ('<a title="a>b">x</a> y', "x y"), ("a<script>if (a < b) {", "a"), ("a<!-- no end", "a"),
    ("1 &lt; 2 &amp;lt; 3", "1 < 2 &lt; 3"), ("R&D &bogus; &#0; &#xD800; &amp", "R&D &bogus; \ufffd \ufffd &"),
    ("<p don't>x</p>", "x"), ("a&nbsp;&nbsp;b", "a b"), (None, ""), ("<style>p{}</style>&#128512;", "\U0001F600")])
def test_clean_html(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "t string").select(T.clean_html("t").alias("t")).first()
    assert row["t"] == want


def test_imputation_ignores_any_whitespace(spark):
    df = spark.createDataFrame([("\n\n\n\n", "real title"), ("\u00a0\u00a0\u00a0", "real title"), ("\tabc\n", "x")],
                               "a string, b string")
    got = [r["t"] for r in df.select(T.impute_text(["a", "b"]).alias("t")).collect()]
    assert got == ["real title", "real title", "abc"]


def test_json_layouts_are_detected(spark, tmp_path):
    rows = [{"Title": f"t{i}", "Brand": "b", "Category.Name.Value": "c"} for i in range(5)]
    files = {"records": json.dumps(rows), "lines": "\n".join(map(json.dumps, rows)),
             "columns": json.dumps({c: {str(i): r[c] for i, r in enumerate(rows)} for c in rows[0]})}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
        got = load_products(spark, str(tmp_path / f"{name}.json"))
        assert sorted(r["Title"] for r in got.collect()) == [f"t{i}" for i in range(5)], name
        ids = [r["row_id"] for r in got.collect()]
        assert len(set(ids)) == 5 and ids == [r["row_id"] for r in got.collect()]


def test_payload_with_brackets_and_bad_indices(spark):
    page = ('{"label": ["a [x]", "Cluster 1", "q\\"]"], "source": [0, 2, 9], "target": [1, 1, 1], "value": [3, 4, 5]}')
    got = FL.extract_embedded_links(spark.createDataFrame([("p", page)], "k string, html string"), "k").collect()
    assert sorted((r["cluster_id"], r["category"], r["count"]) for r in got) == [("1", "a [x]", 3.0), ("1", 'q"]', 4.0)]


def labelings(spark, table):
    return spark.createDataFrame([(f"a{o}", o, r, c) for o, row in enumerate(table) for r, c in enumerate(row)],
                                 "algo string, algo_ord int, row_id long, cluster int")


def test_consensus_joins_what_most_labelings_join(spark):
    lab = labelings(spark, [[0, 0, 0, 1, 1, -1, -1], [5, 5, 6, 7, 7, -1, -1], [2, 3, 3, 4, 4, 9, 9]])
    got = {r["row_id"]: r["cluster"] for r in EN.consensus(lab).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3}
    strict = {r["row_id"]: r["cluster"] for r in EN.consensus(lab, 3).collect()}
    assert strict == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 5}
    with pytest.raises(ValueError):
        EN.consensus(lab, 4)


def test_a_labeling_without_overlap_stays(spark):
    lab = labelings(spark, [[0, 0, 1, -1, -1], [-1, -1, -1, 3, 7]])
    got = {(r["algo"], r["row_id"]): r["cluster"] for r in EN.align_labels(lab).collect()}
    assert got["a1", 3] == 3 and got["a1", 4] == 7


def test_birch_gives_the_clusters_it_is_asked_for_at_any_limit(spark, monkeypatch):
    rows = [(i, [float(i % 20), float(i // 20) / 50]) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    want = B.birch(df, 0.3, 5).select("cluster").distinct().count()
    monkeypatch.setattr(B, "BROADCAST_LIMIT_BYTES", 1)
    assert B.birch(df, 0.3, 5).select("cluster").distinct().count() == want == 5


def test_nested_tree(spark):
    clusters = spark.createDataFrame([(1, 4, 1.0, "a"), (2, 6, 0.5, "a"), (3, 2, 0.9, "b")],
                                     "cluster_id int, size long, purity double, dominant_category string")
    rich = spark.createDataFrame([("1", 1, "a", 4, 100.0)],
                                 "cluster_id string, rank long, name string, count long, percentage double")
    got = {r["name"]: r for r in X.tree_nested(clusters, rich, 0.6).collect()}
    assert got["a"]["size"] == 4 and [c["children"][0]["name"] for c in got["a"]["children"]] == ["a"]
    assert got["b"]["children"][0]["name"] == "Cluster 3" and got["b"]["children"][0]["children"] == []


def test_cache_encodes_missing_rows_only(spark, tmp_path):
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.select("row_id", F.array(F.length("cluster_text").cast("double")).alias("embedding"))

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "row_id long, cluster_text string")
    path = str(tmp_path / "cache")
    assert refresh_cache(spark, rows.limit(4), path, "e", encode).count() == 4
    assert refresh_cache(spark, rows, path, "e", encode).count() == 6
    changed = rows.withColumn("cluster_text", F.when(F.col("row_id") == 2, "new").otherwise(F.col("cluster_text")))
    assert refresh_cache(spark, changed, path, "e", encode).count() == 6
    assert seen == [4, 2, 1]
