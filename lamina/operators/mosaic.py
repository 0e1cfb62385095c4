"""Cutting a projection into mosaic tiles, and stitching tiles into one projection again.

The catalog is joined by containment: it has a row per tile, and its ranges are turned into equal keys by cutting rows into
bands of BAND lines, so that no pair of pixel and tile is tried that doesn't share a band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines
from .model import filled

BAND = 64


def cut(stack: DataFrame, tiles: DataFrame, half: int) -> DataFrame:
    """Tiles (scan, zi, xi, t, z, x, v) over a full turn from a stack (scan, t, z, x, v) over half of one: the direct crop,
    then the mirrored crop flipped. tiles has footprints() of the catalog."""
    keys = ["scan", "zi", "xi"]
    bands = tiles.select(*keys, "r_lo", "r_hi", "c_lo", "c_hi", "c_lo_mirror", "c_hi_mirror", F.explode(F.sequence(F.floor(F.col("r_lo") / BAND), F.floor((F.col("r_hi") - 1) / BAND))).alias("_band"))
    near = stack.withColumn("_band", F.floor(F.col("z") / BAND)).join(bands, ["scan", "_band"]).where((F.col("z") >= F.col("r_lo")) & (F.col("z") < F.col("r_hi")))
    row = (F.col("z") - F.col("r_lo")).alias("z")
    direct = F.when((F.col("x") >= F.col("c_lo")) & (F.col("x") < F.col("c_hi")), F.struct(F.col("t").cast("int").alias("t"), (F.col("x") - F.col("c_lo")).cast("int").alias("x")))
    mirrored = F.when((F.col("x") >= F.col("c_lo_mirror")) & (F.col("x") < F.col("c_hi_mirror")), F.struct((F.col("t") + half).cast("int").alias("t"), (F.col("c_hi_mirror") - 1 - F.col("x")).cast("int").alias("x")))
    both = near.select(*keys, row, "v", F.explode(F.array(direct, mirrored)).alias("_p")).where("_p is not null")
    return both.select(*keys, "_p.t", F.col("z").cast("int").alias("z"), "_p.x", "v")


def cut_lines(stack: DataFrame, tiles: DataFrame, half: int) -> DataFrame:
    """cut() in row form: lines (scan, zi, xi, t, z, v array) of tiles from lines (scan, t, z, v array)."""
    keys = ["scan", "zi", "xi"]
    bands = tiles.select(*keys, "r_lo", "r_hi", "c_lo", "c_hi", "c_lo_mirror", "c_hi_mirror", F.explode(F.sequence(F.floor(F.col("r_lo") / BAND), F.floor((F.col("r_hi") - 1) / BAND))).alias("_band"))
    near = stack.withColumn("_band", F.floor(F.col("z") / BAND)).join(bands, ["scan", "_band"]).where((F.col("z") >= F.col("r_lo")) & (F.col("z") < F.col("r_hi")))
    part = lambda low, high: F.slice("v", (F.col(low) + 1).cast("int"), (F.col(high) - F.col(low)).cast("int"))
    direct = F.struct(F.col("t").cast("int").alias("t"), part("c_lo", "c_hi").alias("v"))
    mirrored = F.struct((F.col("t") + half).cast("int").alias("t"), F.reverse(part("c_lo_mirror", "c_hi_mirror")).alias("v"))
    both = near.select(*keys, (F.col("z") - F.col("r_lo")).cast("int").alias("z"), F.explode(F.array(direct, mirrored)).alias("_p"))
    return both.select(*keys, "_p.t", "z", "_p.v")


def stitched_planes(tile_lines: DataFrame, tiles: DataFrame, half: int, nz: int, n: int, fill: float = 1.0) -> DataFrame:
    """stitched() in row form: planes (scan, t, lines, v) of lines (scan, zi, xi, t, z, v array). What no tile covers is air."""
    catalog = tiles.select("scan", "zi", "xi", "r_lo", "r_hi", "c_lo", "c_lo_mirror", "overlap")
    near = tile_lines.join(catalog, ["scan", "zi", "xi"])
    second = F.col("t") >= half
    weight = F.least(F.col("z") + 0.5, F.col("r_hi") - F.col("r_lo") - 0.5 - F.col("z"), F.col("overlap"))
    line = F.struct(
        ((F.col("r_lo") + F.col("z")) * n + F.when(second, F.col("c_lo_mirror")).otherwise(F.col("c_lo"))).cast("int").alias("at"),
        weight.cast("double").alias("w"), F.col("overlap").cast("double").alias("cap"), F.when(second, F.reverse("v")).otherwise(F.col("v")).alias("v"),
    )
    listed = near.groupBy("scan", (F.col("t") % half).cast("int").alias("t")).agg(F.collect_list(line).alias("_l"))
    every = tiles.select("scan").distinct().select("scan", F.explode(F.sequence(F.lit(0), F.lit(half - 1))).alias("t"))
    found = every.join(listed, ["scan", "t"], "left").select("scan", "t", *[F.col(f"_l.{c}").alias(c) for c in ("at", "w", "cap", "v")])

    def fn(some: pa.RecordBatch) -> np.ndarray:
        at, w, cap, rows = (some.column(c).flatten() for c in ("at", "w", "cap", "v"))
        sizes = lines.lengths(rows)
        first = np.repeat(np.arange(some.num_rows) * (nz * n), lines.lengths(some.column("at"))) + at.to_numpy()
        j = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        weights = np.repeat(w.to_numpy(), sizes) * np.minimum(np.minimum(j + 0.5, np.repeat(sizes, sizes) - 0.5 - j), np.repeat(cap.to_numpy(), sizes))
        place, total = np.repeat(first, sizes) + j, some.num_rows * nz * n
        v, all_weights = np.bincount(place, weights * rows.flatten().to_numpy(), total), np.bincount(place, weights, total)
        return np.divide(v, all_weights, out=np.full(total, fill), where=all_weights != 0).reshape(some.num_rows, -1)

    return lines.planes_of(found, ["scan", "t"], fn, nz, n)


def tent(i: Column, j: Column, height: Column, width: Column, cap: Column) -> Column:
    """A pixel's weight in the blend: its distance to the nearest edge of its tile, at most cap, along each axis, multiplied."""
    along = lambda k, n: F.least(k + 0.5, n - 0.5 - k, cap)
    return along(i, height) * along(j, width)


def placed(tile_pixels: DataFrame, tiles: DataFrame, half: int) -> DataFrame:
    """Each tile pixel at its place in the projection, with its weight: the second half turn is flipped back and mirrored."""
    catalog = tiles.select("scan", "zi", "xi", "r_lo", "r_hi", "c_lo", "c_hi", "c_lo_mirror", "overlap")
    near = tile_pixels.join(catalog, ["scan", "zi", "xi"])
    width = F.col("c_hi") - F.col("c_lo")
    second = F.col("t") >= half
    column = F.when(second, F.col("c_lo_mirror") + width - 1 - F.col("x")).otherwise(F.col("c_lo") + F.col("x"))
    weight = tent(F.col("z"), F.col("x"), F.col("r_hi") - F.col("r_lo"), width, F.col("overlap"))
    return near.select("scan", (F.col("t") % half).cast("int").alias("t"), (F.col("r_lo") + F.col("z")).cast("int").alias("z"), column.cast("int").alias("x"), weight.cast("double").alias("w"), "v")


def checked(tile_pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_pixels, if it has all tiles of the catalog; an error names those that it lacks. Runs a job over its keys."""
    keys = ["scan", "zi", "xi"]
    missing = tiles.select(*keys).join(tile_pixels.select(*keys).distinct(), keys, "left_anti").orderBy(*keys).limit(10).collect()
    if missing:
        raise ValueError(f"tiles without data: {', '.join(str(tuple(r)) for r in missing)}")
    return tile_pixels


def stitched(tile_pixels: DataFrame, tiles: DataFrame, half: int) -> DataFrame:
    """(scan, t, z, x, v): the weighted mean of all tiles that cover a pixel. Sums are made before the shuffle."""
    sums = placed(tile_pixels, tiles, half).groupBy("scan", "t", "z", "x").agg(F.sum(F.col("w") * F.col("v")).alias("_s"), F.sum("w").alias("_w"))
    return sums.select("scan", "t", "z", "x", (F.col("_s") / F.col("_w")).alias("v"))


def uncovered_filled(values: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Pixels that no tile covers become 1: air."""
    return filled(values, sizes, fill=1.0)
