"""Content-keyed embedding cache.

The cache is a parquet table ``(encoder, row_id, fingerprint, embedding)``.
A row needs (re-)encoding when its (row_id, fingerprint) is not cached for the
encoder — a left-anti join, so only missing rows are encoded.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.schema import ROW_ID


def fingerprint(df: DataFrame, text_col: str = "cluster_text", key: str = ROW_ID) -> DataFrame:
    return df.withColumn("fingerprint", F.xxhash64(F.col(key), F.col(text_col)))


def rows_missing_from_cache(rows: DataFrame, cached: DataFrame, key: str = ROW_ID,
                            on: list[str] | None = None) -> DataFrame:
    """Rows whose key (and fingerprint, when given) has no cache entry."""
    on = on or [key]
    return rows.join(cached.select(*on), on=on, how="left_anti")


def refresh_cache(spark, rows: DataFrame, cache_path: str, encoder_name: str, encode) -> DataFrame:
    """Encode only missing rows with ``encode(df) -> df(row_id, embedding)``, append them.

    Returns the cache restricted to the current rows and fingerprints.
    """
    rows = fingerprint(rows)
    try:
        cached = spark.read.parquet(cache_path).filter(F.col("encoder") == encoder_name)
    except AnalysisException as e:  # first run: no cache yet
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        cached = None
    missing = rows if cached is None else rows_missing_from_cache(
        rows, cached, on=[ROW_ID, "fingerprint"])
    fresh = encode(missing).join(missing.select(ROW_ID, "fingerprint"), ROW_ID)
    (fresh.withColumn("encoder", F.lit(encoder_name))
     .write.mode("append").parquet(cache_path))
    all_cached = spark.read.parquet(cache_path).filter(F.col("encoder") == encoder_name)
    return all_cached.join(rows.select(ROW_ID, "fingerprint"), [ROW_ID, "fingerprint"], "left_semi")
