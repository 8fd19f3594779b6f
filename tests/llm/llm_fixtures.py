"""Fixtures of these tests; ``spark`` and ``duck`` come from the folder above."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
#: Rows that every operator must take: null, empty, blank, repeated and tied rows, a null id, a very long text.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "no id here at all today"),
       (5, "the same words " * 30_000), (6, "ünïcödé ★ \x00 ½ <|endoftext|> ▁ 漢字 \x1c Σας é"),
       (7, "a b c d e f g"), (8, "a b c d e f g")]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=()):
        """Documents from ``(id, text)`` pairs, with columns of clashing names if asked for."""
        df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], SCHEMA)
        for name in extra:
            df = df.withColumn(name, F.lit("x"))
        return df
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")
