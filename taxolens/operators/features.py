"""Text feature construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.functions.text import clean_html, impute_text, normalize_ws
from taxolens.schema import TEXT_COLS


def create_text_features(df: DataFrame, text_cols: Sequence[str] = TEXT_COLS,
                         out_col: str = "cluster_text", min_len: int = 2) -> DataFrame:
    """P5: clean HTML in each present text column, impute, normalise, keep len > 2.

    A single narrow projection + filter: no shuffle, fully codegen'd.
    """
    present = [c for c in text_cols if c in df.columns]
    cleaned = df.select(*[clean_html(F.col(c)).alias(c) if c in present else F.col(c)
                          for c in df.columns])
    out = cleaned.withColumn(out_col, normalize_ws(impute_text(text_cols, present)))
    return out.filter(F.length(out_col) > min_len)


def rejection_rate(df: DataFrame, text_cols: Sequence[str] = TEXT_COLS,
                   min_len: int = 2) -> DataFrame:
    """Rows kept, dropped, and dropped/initial after text cleaning."""
    present = [c for c in text_cols if c in df.columns]
    cleaned = df.select(*[clean_html(F.col(c)).alias(c) for c in present])
    flagged = cleaned.select((F.length(normalize_ws(impute_text(text_cols, present))) > min_len)
                             .alias("keep"))
    return flagged.agg(
        F.count(F.when(F.col("keep"), 1)).alias("kept"),
        F.count(F.when(~F.col("keep"), 1)).alias("dropped"),
        (F.count(F.when(~F.col("keep"), 1)) / F.count(F.lit(1))).alias("drop_ratio"),
    )
