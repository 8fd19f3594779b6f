"""Vector column expressions on ``array<double>`` (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _col(c).cast("array<double>")


def sq_distance(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays."""
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def distance(a, b) -> Column:
    """V4: Euclidean distance."""
    return F.sqrt(sq_distance(a, b))


def sq_norm(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x * x)
