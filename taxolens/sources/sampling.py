"""Exact-n seeded sampling and applying one sample to aligned frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.schema import ROW_ID, SEED


def sample_key(key: str = ROW_ID, seed: int = SEED) -> Column:
    """Order-independent pseudo-random key: md5 of ``seed|key``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_exact(df: DataFrame, n: int, key: str = ROW_ID, seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, count)`` rows, without replacement, reproducible.

    Planned as TakeOrderedAndProject: each partition keeps its n smallest
    hash keys and only n·partitions rows reach the final merge, so the cost
    is one scan regardless of table size.
    """
    return df.orderBy(sample_key(key, seed), F.col(key)).limit(n)


def sample_ids(df: DataFrame, n: int, key: str = ROW_ID, seed: int = SEED) -> DataFrame:
    """The sampled keys only (persist once, then semi-join every aligned frame)."""
    return sample_exact(df.select(key), n, key, seed)


def restrict_to(df: DataFrame, ids: DataFrame, key: str = ROW_ID) -> DataFrame:
    """Keep rows whose key is in ``ids`` (left-semi join; ids are ≤ n rows)."""
    return df.join(F.broadcast(ids.select(key)), on=key, how="left_semi")
