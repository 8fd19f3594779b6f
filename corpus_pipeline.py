"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and judges all documents that its predecessor kept. All but the last return
the columns of ``documents``. Defined cases are those of the operators: a null text is empty, rows with a null id are
judged by their own text and are nobody's duplicate, an empty table stays empty. Documents that reach the near-duplicate
stage more than once under one id leave it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.llm import decontaminate, jaccard_join, quality, sentencepiece_fst, toxicity
from taxolens.llm.common import labelled, read_table, shared_folder
from taxolens.session import ship_package


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages score below the cut; learned from the labelled ones among ``docs``."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the cut; learned from the labelled ones among ``docs``."""
    labels = read_table(spark, sf_dir, "labels")
    some = labelled(docs, labels, "quality", F.lit(True), quality.MAX_LABELLED)
    return quality.drop_poor(docs, quality.learn(quality.describe(some), labels, F.lit(True)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group that near-duplicate links connect."""
    return jaccard_join.drop_near_duplicates(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the documents that are left."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_test_items),
    ("sentencepiece", encoded),
]

#: No stage can be written in SQL: models are fitted, and pieces are merged by rank.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again."""
    ship_package(spark)
    folder = shared_folder(spark, "corpus-pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
