"""Product JSON source with an explicit schema.

``format='auto'`` picks the reader from the head of the file: ``[`` → one JSON
document of records, an object whose first value is an object → a
column-oriented document ``{col: {idx: val}}`` (pandas' default ``to_json``),
reshaped with a pivot on the column name, otherwise JSON lines. Documents are
read in parallel (``json_document``); rows are numbered by their place in them.
Row ids are assigned once and kept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxolens.schema import LABEL_COL, PRODUCT_SCHEMA, ROW_ID, TEXT_COLS, TRUTH
from taxolens.sources.json_document import fragments, read_columns, read_records
from taxolens.session import cut_lineage


_COLUMNS = re.compile(r'\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\{')


def _detect(spark: SparkSession, path: str) -> str:
    # up to the twentieth comma: a document may be a single line
    lines = fragments(spark, path).select(F.substring("value", 1, 2000).alias("v")).limit(20).collect()
    head = ",".join(r["v"] or "" for r in lines).lstrip()
    return "records" if head.startswith("[") else "columns" if _COLUMNS.match(head) else "lines"


def load_products(spark: SparkSession, path: str, fmt: str = "auto",
                  schema: T.StructType = PRODUCT_SCHEMA) -> DataFrame:
    """Read product records; rename the dotted label column to ``true_label``.

    Missing paths raise ``AnalysisException`` (PATH_NOT_FOUND) eagerly.
    """
    if fmt == "auto":
        fmt = _detect(spark, path)
    if fmt == "records":
        df = (read_records(spark, path).select("element", F.from_json("text", schema).alias("r"))
              .select(F.col("element").alias(ROW_ID), "r.*"))
    elif fmt == "lines":
        df = spark.read.schema(schema).json(path).withColumn(ROW_ID, F.monotonically_increasing_id())
    elif fmt == "columns":
        df = read_columns(spark, path, [f.name for f in schema.fields]).withColumnRenamed("_idx", ROW_ID)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    cols = [F.col(f"`{c}`") for c in TEXT_COLS if c in df.columns]
    return cut_lineage(df.select(ROW_ID, *cols, F.col(f"`{LABEL_COL}`").alias(TRUTH)))


def source_shape(df: DataFrame) -> DataFrame:
    """Row count and column count of a source frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
