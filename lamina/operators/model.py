"""Data model: dense arrays as tables.

Long form has a row per element: a volume is (z, y, x, v), a stack of projections (t, z, x, v), a wave (t, z, x, re, im).
Row form has an array per line, (t, z, row) or (z, y, row). Long form is for relational operators, row form for those that
work along lines. An element that is missing is a missing row, never a fill value, until an operator fills the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """All index tuples of an array with these axes, in the order given, generated in parallel."""
    total = 1
    for n in sizes.values():
        total *= n
    rows, rest = spark.range(total), total
    for name, n in sizes.items():
        rest //= n
        rows = rows.withColumn(name, (F.floor(F.col("id") / rest) % n).cast("int"))
    return rows.drop("id")


def filled(values: DataFrame, sizes: dict[str, int], fill: float = 0.0, value: str = "v") -> DataFrame:
    """values on the whole grid, elements without a row being ``fill``."""
    full = grid(values.sparkSession, **sizes)
    return full.join(values, list(sizes), "left").select(*sizes, F.coalesce(F.col(value), F.lit(fill)).cast("double").alias(value))


def to_rows(values: DataFrame, *keys: str, axis: str = "x", value: str = "v") -> DataFrame:
    """Long form to row form: one array per key, ordered along the axis. A line is a bounded group: one detector row."""
    line = F.array_sort(F.collect_list(F.struct(axis, value)))
    return values.groupBy(*keys).agg(F.transform(line, lambda s: s[value]).alias("row"))


def to_long(rows: DataFrame, *keys: str, axis: str = "x", value: str = "v") -> DataFrame:
    return rows.select(*keys, F.posexplode("row").alias(axis, value))


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)
