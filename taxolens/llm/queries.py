"""Registered queries of this package and their DuckDB SQL (none where SQL can't express an operator)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.llm import (
    conversation_repair,
    decontaminate,
    fingerprints,
    html_extract,
    jaccard_join,
    lexical_search,
    license_scan,
    quality,
    secret_scan,
    sentencepiece_fst,
    token_store,
    toxicity,
    url_filter,
)
from taxolens.llm.common import keep, read_table
from taxolens.session import ship_package


def fold(k: int):
    """Remainder of the crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % k


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    seen = keep(quality.describe(docs))
    model = quality.learn(seen, labels, fold(5) != 0)
    return quality.score(seen, model).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, fold(3) != 1)
    out = toxicity.score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= toxicity.CUT, 1).otherwise(0).alias("predicted"),
                      F.size("spans").alias("n_passages"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(read_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(read_table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_quality, op2_fingerprints, op3_decontamination, op4_html_extraction, op5_license_scan,
            op6_jaccard_join, op7_toxicity, op8_token_ids, op9_url_filter, op10_sentencepiece,
            op11_secret_scan, op12_lexical_search, op13_conversation_repair, pipeline)


def _shipped(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries():
    return {f.__name__: _shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": license_scan.scan_sql(), "op9_url_filter": url_filter.judge_sql(),
            "op12_lexical_search": lexical_search.search_sql(),
            "op13_conversation_repair": conversation_repair.repair_sql()}
