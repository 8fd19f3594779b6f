"""The corpus pipeline: stages act on what their predecessor kept."""

from llm_fixtures import SF_SMALL, make_docs  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline as C
from taxolens.llm import decontaminate, jaccard_join


def test_stages_at_the_small_scale(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF_SMALL).persist()
        kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "sentencepiece":
            assert out.columns == docs.columns
            assert kept[name] <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "near_duplicates":
            assert jaccard_join.near_duplicates(out).filter("doc_id <> class_id").count() == 0
        if name == "decontamination":
            assert decontaminate.find_items(out, bench).count() == 0
        docs = out
    good = labels.filter("quality = 1 and toxic = 0").select("doc_id")
    all_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").join(good, "doc_id", "left_semi")
    lost = {r["doc_id"] for r in all_docs.collect()} - kept["quality"]
    assert len(lost) <= 0.05 * all_docs.count()
    assert {r["doc_id"] for r in C.run(spark, SF_SMALL).collect()} == kept["sentencepiece"]


def test_odd_rows_pass_every_stage(spark, make_docs, tmp_path):
    rows = [(1, None), (2, ""), (4, "one"), (4, "one"), (None, "no id here"), (7, "a b c d e f g"),
            (8, "a b c d e f g")]
    docs = make_docs(rows, ("node", "x", "_keep", "place"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some other words to find")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        out = start
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        ids = sorted(r["doc_id"] for r in C.STAGES[-1][1](spark, out, str(tmp_path)).filter(
            F.col("doc_id").isNotNull()).collect())
        assert ids == ([1, 4, 7] if start is docs else [])


def test_the_least_text_of_an_id_stays(spark, make_docs):
    rows = [(1, "b b b b b b b"), (1, "a b c d e f g"), (1, None), (2, "z y x w v u t"), (2, "z y x w v u t")]
    for parts in (1, 3):
        kept = jaccard_join.drop_near_duplicates(make_docs(rows, ("_keep",)).repartition(parts)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, None), (2, "z y x w v u t")]
