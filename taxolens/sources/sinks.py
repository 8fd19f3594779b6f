"""S6/S7/S10 sinks: report CSVs, composition JSON, cluster table JSON.

Parquet is the primary format; CSV/JSON are for people and the explorer. A
report is written as one file only when its row count is under a bound
(reports are per-cluster tables); larger outputs keep Spark's part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SINGLE_FILE_MAX_ROWS = 1_000_000


def _maybe_single(df: DataFrame, max_rows: int) -> DataFrame:
    return df.coalesce(1) if df.count() <= max_rows else df


def write_csv(df: DataFrame, path: str, max_rows: int = SINGLE_FILE_MAX_ROWS) -> None:
    """Header CSV (index-free)."""
    _maybe_single(df, max_rows).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, max_rows: int = SINGLE_FILE_MAX_ROWS) -> None:
    """One JSON object per row (composition per cluster, or cluster table rows)."""
    _maybe_single(df, max_rows).write.mode("overwrite").json(path)


def write_cluster_table(stats: DataFrame, path: str) -> None:
    """``cluster_id, size, purity, dominant_category`` for the explorer."""
    write_json_lines(stats.select("cluster_id", "size", "purity", "dominant_category"), path)


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local on a cluster)."""
    import uuid

    from taxolens.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
