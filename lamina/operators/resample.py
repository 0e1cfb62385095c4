"""Resampling of long-form volumes. Three conventions that differ: aligned corners in the plane, planes blended to the next
one, and a scaled z axis with zeros outside."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import grid


def zoomed_axis(values: DataFrame, axis: str, size: int, target: int) -> DataFrame:
    """Linear interpolation of one axis to ``target`` samples with the first and last ones in place.

    Each sample gives its weighted share to the outputs near it, and an aggregation adds up at most two shares of each: the
    partial sums are made before the shuffle.
    """
    if size == target:
        return values
    others = [c for c in values.columns if c not in (axis, "v")]
    step = (size - 1) / (target - 1) if target > 1 else 0.0
    low = F.greatest(F.lit(0), F.ceil((F.col(axis) - 1) / step) if step else F.lit(0)).cast("int")
    high = F.least(F.lit(target - 1), F.floor((F.col(axis) + 1) / step) if step else F.lit(target - 1)).cast("int")
    shares = values.withColumn("_o", F.explode(F.sequence(low, high))).withColumn("_w", 1.0 - F.abs(F.col("_o") * step - F.col(axis)))
    return shares.where("_w > 0").groupBy(*others, F.col("_o").alias(axis)).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def upsampled_planes(values: DataFrame, size: int, factor: int) -> DataFrame:
    """(z, y, x, v) with y and x enlarged by factor, corners aligned."""
    return zoomed_axis(zoomed_axis(values, "x", size, size * factor), "y", size, size * factor)


def upsampled_z(values: DataFrame, factor: int) -> DataFrame:
    """Each plane followed by factor - 1 blends to the next one; the last plane is repeated."""
    after = F.lead("v", 1).over(Window.partitionBy("y", "x").orderBy("z"))
    both = values.withColumn("_n", F.coalesce(after, F.col("v"))).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    share = F.col("_r") / factor
    return both.select((F.col("z") * factor + F.col("_r")).cast("int").alias("z"), "y", "x", ((1 - share) * F.col("v") + share * F.col("_n")).alias("v"))


def scaled_z(values: DataFrame, planes: int, zoom: float, target: int) -> DataFrame:
    """Plane z of the target is at z / zoom: between two planes a blend, on the last one a copy, beyond it nothing (0)."""
    out = grid(values.sparkSession, _z=target).withColumn("_at", F.col("_z") / F.lit(zoom)).withColumn("_low", F.floor("_at").cast("int"))
    taps = out.select("_z", F.explode(F.array(F.struct(F.col("_low").alias("z"), F.when(F.col("_low") + 1 < planes, 1 - (F.col("_at") - F.col("_low"))).otherwise(1.0).alias("w")), F.struct((F.col("_low") + 1).alias("z"), (F.col("_at") - F.col("_low")).alias("w")))).alias("s"))
    taps = taps.select("_z", "s.z", "s.w").where((F.col("z") >= 0) & (F.col("z") < planes))  # two rows for each target plane
    near = values.join(F.broadcast(taps) if target <= 1_000_000 else taps, "z")
    return near.groupBy(F.col("_z").alias("z"), "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def repeated(values: DataFrame, factor: int, *axes: str) -> DataFrame:
    """Nearest neighbours: each element factor times along each axis."""
    for axis in axes:
        values = values.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(axis, F.col(axis) * factor + F.col("_r")).drop("_r")
    return values


def block_means(values: DataFrame, factor: int, sizes: dict[str, int]) -> DataFrame:
    """Means of blocks of factor elements along each axis; a rest at the end is left out."""
    for axis, n in sizes.items():
        values = values.where(F.col(axis) < n // factor * factor).withColumn(axis, F.floor(F.col(axis) / factor).cast("int"))
    return values.groupBy(*[c for c in values.columns if c != "v"]).agg(F.avg("v").alias("v"))


def gaussian_taps(sigma: float) -> list[float]:
    """Normalised weights at -r..r, r being four sigma rounded."""
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / sum(weights) for w in weights]


def smoothed(values: DataFrame, sigma: float, sizes: dict[str, int]) -> DataFrame:
    """A Gaussian along each axis in turn, with 0 outside. Each element gives a share to its neighbours."""
    if sigma <= 0:
        return values
    taps = gaussian_taps(sigma)
    reach = len(taps) // 2
    for axis, n in sizes.items():
        shares = F.array(*[F.struct((F.col(axis) + k - reach).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(taps)])
        spread = values.withColumn("_s", F.explode(shares)).where((F.col("_s.o") >= 0) & (F.col("_s.o") < n))
        others = [c for c in values.columns if c not in (axis, "v")]
        values = spread.groupBy(*others, F.col("_s.o").alias(axis)).agg(F.sum(F.col("_s.w") * F.col("v")).alias("v"))
    return values


def sharpened(values: DataFrame, amount: float, sigma: float, sizes: dict[str, int]) -> DataFrame:
    """v + amount (v - smoothed v)."""
    if not amount:
        return values
    keys = [c for c in values.columns if c != "v"]
    soft = smoothed(values, sigma, sizes).withColumnRenamed("v", "_g")
    return values.join(soft, keys).withColumn("v", F.col("v") + amount * (F.col("v") - F.col("_g"))).drop("_g")
