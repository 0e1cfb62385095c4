"""Scalar functions that Spark lacks, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def frequency(k: Column, n: int, spacing: float = 1.0) -> Column:
    """Of bin k of a transform of n samples."""
    return F.when(k < (n + 1) // 2, k).otherwise(k - n) / (n * spacing)
