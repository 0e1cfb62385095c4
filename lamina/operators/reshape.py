"""Crops, pads, flips, masks and folds of long-form arrays: expressions and index arithmetic, joined only to fill a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import filled


def rectangle(values: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """The elements with each index in its half-open range, counted from its start. Filters reach the scan."""
    for axis, (low, high) in ranges.items():
        values = values.where((F.col(axis) >= low) & (F.col(axis) < high))
    return values.withColumns({axis: F.col(axis) - low for axis, (low, _) in ranges.items()})


def centred(values: DataFrame, source: dict[str, int], target: dict[str, int]) -> DataFrame:
    """The centre of an array, or where the target is larger the array centred in zeros."""
    shifts = {a: (source[a] - target[a]) // 2 for a in target}
    moved = values.withColumns({a: F.col(a) - shifts[a] for a in target})
    for a, n in target.items():
        moved = moved.where((F.col(a) >= 0) & (F.col(a) < n))
    return filled(moved, source | target) if any(target[a] > source[a] for a in target) else moved


def flipped(values: DataFrame, axis: str, size: int) -> DataFrame:
    return values.withColumn(axis, F.lit(size - 1) - F.col(axis))


def strided(values: DataFrame, **steps: int) -> DataFrame:
    """Every step-th element along each axis, re-indexed."""
    for axis, step in steps.items():
        values = values.where(F.col(axis) % step == 0)
    return values.withColumns({axis: F.floor(F.col(axis) / step).cast("int") for axis, step in steps.items()})


def circular_mask(y: Column, x: Column, size: int, radius: float, taper: float) -> Column:
    """1 within the radius about the centre, falling to 0 by half a cosine over the taper; a sharp edge without one."""
    centre = (size - 1) / 2
    rho = F.sqrt((y - centre) * (y - centre) + (x - centre) * (x - centre))
    if taper <= 0:
        return F.when(rho <= radius, 1.0).otherwise(0.0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (radius - rho) / taper + 0.5))
    return 0.5 - 0.5 * F.cos(math.pi * t)


def z_weight(z: Column, pad: int, size: int, taper: int) -> Column:
    """0 outside the ``size`` slices after ``pad``; near their ends a cosine over ``taper`` slices; else 1."""
    depth = F.least(z - pad, F.lit(pad + size - 1) - z)
    return F.when(depth < 0, 0.0).when(depth >= taper, 1.0).otherwise(0.5 - 0.5 * F.cos(math.pi * (depth + 0.5) / taper))


def reflected(i: Column, size: int) -> Column:
    """The index that i stands for when an axis is mirrored at its ends, each end sample twice, over and over."""
    at = F.pmod(i, F.lit(2 * size))
    return F.when(at < size, at).otherwise(2 * size - 1 - at).cast("int")


def padded_rows(row: Column, before: int, after: int, mode: str) -> Column:
    """A line in row form with samples added at both ends: ``mirror`` (each end sample twice), ``edge`` or ``zero``."""
    if mode == "zero":
        return F.concat(F.array_repeat(F.lit(0.0), before), row, F.array_repeat(F.lit(0.0), after))
    if mode == "edge":
        return F.concat(F.array_repeat(F.element_at(row, 1), before), row, F.array_repeat(F.element_at(row, -1), after))
    if mode == "mirror":
        return F.concat(F.reverse(F.slice(row, 1, before)), row, F.reverse(F.slice(row, -after, after)))
    raise ValueError(f"unknown mode of padding: {mode}")


def mirror_padded(values: DataFrame, **sizes: int) -> DataFrame:
    """Both ends of each axis mirrored by half its size, so that it has twice as many elements. Each element is repeated where
    it is needed: no join."""
    for axis, n in sizes.items():
        half = n // 2
        at = F.col(axis)
        copies = F.filter(F.array(at + half, F.when(at < half, F.lit(half - 1) - at), F.when(at >= n - half, F.lit(2 * n - 1 + half) - at)), lambda k: k.isNotNull())
        values = values.withColumn(axis, F.explode(copies)).withColumn(axis, F.col(axis).cast("int"))
    return values


def full_turn(direct: DataFrame, mirrored: DataFrame, half: int, width: int) -> DataFrame:
    """A tile over a full turn: its own crop for the first half, the flipped mirrored crop for the second."""
    return direct.unionByName(flipped(mirrored, "x", width).withColumn("t", F.col("t") + half))


def folded(values: DataFrame, half: int) -> DataFrame:
    """A full turn's elements on the half turn: t modulo half, and whether it came from the second."""
    return values.withColumns({"second": (F.col("t") >= half).cast("int"), "t": F.col("t") % half})
