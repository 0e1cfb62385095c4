"""Geometry of mosaic scans, as operators on a table of scans.

A scan has the columns det_h, det_w, overlap, inset, z_overlap (detector pixels), sample_r, sample_h (pixels), nz, n (size of
the projection) and z_pad. Everything is derived by expressions and ``explode(sequence)``, so a catalog of any number of
scans is laid out in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Detector and sample at the reference upsampling of 8 (fixed values).
REF_UPS, REF_DET_W, REF_DET_H, REF_OVERLAP, REF_PIXEL_UM = 8, 3232, 2426, 200, 1.38
SAMPLE_D_PER_UPS, SAMPLE_H_PER_UPS, N_PER_UPS = 2918, 2972, 3072


def standard_scans(ups: DataFrame) -> DataFrame:
    """The scan parameters of upsampling factors (ups): detector sizes floored, sample and projection in proportion."""
    scaled = lambda ref: F.floor(F.lit(ref) * F.col("ups") / REF_UPS).cast("int")
    return ups.withColumns(
        {
            "det_h": scaled(REF_DET_H), "det_w": scaled(REF_DET_W), "overlap": scaled(REF_OVERLAP), "inset": scaled(REF_OVERLAP), "z_overlap": scaled(REF_OVERLAP),
            "sample_r": F.col("ups") * SAMPLE_D_PER_UPS / 2, "sample_h": (F.col("ups") * SAMPLE_H_PER_UPS).cast("double"), "n": F.col("ups") * N_PER_UPS, "nz": F.col("ups") * N_PER_UPS,
            "z_pad": F.floor((F.col("ups") * N_PER_UPS - F.col("ups") * SAMPLE_H_PER_UPS) / 2).cast("int"),
        }
    )


def pixel_um(ups: Column) -> Column:
    return F.lit(REF_PIXEL_UM) * REF_UPS / ups


def px_to_mm(v: Column, pixel: Column) -> Column:
    return v * pixel * 1e-3


def mm_to_px(v: Column, pixel: Column) -> Column:
    return v / (pixel * 1e-3)


def with_tiles(scans: DataFrame) -> DataFrame:
    """Adds n_x and n_z, the tiles needed to cover the sample's radius and height, and the symmetric overshoot in z."""
    reach = F.col("det_w") - F.col("inset")
    n_x = F.when(reach >= F.col("sample_r"), 1).otherwise(F.ceil((F.col("sample_r") - reach) / (F.col("det_w") - F.col("overlap"))) + 1)
    n_z = F.when(F.col("sample_h") <= F.col("det_h"), 1).otherwise(F.ceil((F.col("sample_h") - F.col("det_h")) / (F.col("det_h") - F.col("z_overlap"))) + 1)
    span = F.col("n_z") * F.col("det_h") - (F.col("n_z") - 1) * F.col("z_overlap")
    return scans.withColumns({"n_x": n_x.cast("int"), "n_z": n_z.cast("int")}).withColumn("overshoot", (span - F.col("sample_h")) / 2.0)


def placements(scans: DataFrame) -> DataFrame:
    """A row per tile (zi, xi): its centre in the projection and what is cropped of it. Starts are rounded half to even."""
    tiles = with_tiles(scans).withColumn("zi", F.explode(F.sequence(F.lit(0), F.col("n_z") - 1))).withColumn("xi", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)))
    z0 = F.bround(F.col("zi") * (F.col("det_h") - F.col("z_overlap")) - F.col("overshoot"), 0).cast("int") + F.col("z_pad")
    x0 = F.bround((F.col("xi") * (F.col("det_w") - F.col("overlap")) - F.col("inset")).cast("double"), 0).cast("int") + F.floor(F.col("n") / 2).cast("int")
    starts = tiles.withColumns({"z_start": z0, "x_start": x0})
    return starts.withColumns(
        {
            "z_center": F.col("z_start") + F.floor(F.col("det_h") / 2).cast("int"), "x_center": F.col("x_start") + F.floor(F.col("det_w") / 2).cast("int"),
            "crop_top": F.greatest(F.lit(0), -F.col("z_start")), "crop_bottom": F.greatest(F.lit(0), F.col("z_start") + F.col("det_h") - F.col("nz")),
            "crop_left": F.greatest(F.lit(0), -F.col("x_start")), "crop_right": F.greatest(F.lit(0), F.col("x_start") + F.col("det_w") - F.col("n")),
        }
    ).drop("z_start", "x_start")


def footprints(tiles: DataFrame) -> DataFrame:
    """Adds the rows and columns that each tile covers, directly and mirrored at the rotation axis (columns swap sides)."""
    half_h, half_w = F.floor(F.col("det_h") / 2).cast("int"), F.floor(F.col("det_w") / 2).cast("int")
    low = F.col("n") - F.col("x_center") - half_w
    return tiles.withColumns(
        {
            "r_lo": F.col("z_center") - half_h + F.col("crop_top"), "r_hi": F.col("z_center") - half_h + F.col("det_h") - F.col("crop_bottom"),
            "c_lo": F.col("x_center") - half_w + F.col("crop_left"), "c_hi": F.col("x_center") - half_w + F.col("det_w") - F.col("crop_right"),
            "c_lo_mirror": low + F.col("crop_right"), "c_hi_mirror": low + F.col("det_w") - F.col("crop_left"),
        }
    )


def summary(scans: DataFrame) -> DataFrame:
    """Per scan: tiles, the virtual field of view, whether it covers the sample, and all projections (two half turns of n * 3 / 4)."""
    r_out = F.when(F.col("n_x") == 1, F.col("det_w") - F.col("inset")).otherwise((F.col("n_x") - 1) * (F.col("det_w") - F.col("overlap")) - F.col("inset") + F.col("det_w"))
    found = with_tiles(scans).withColumns({"fov_px": 2 * r_out, "n_theta": F.floor(F.col("n") * 3 / 4) * 2})
    return found.withColumns({"covers": F.col("fov_px") >= 2 * F.col("sample_r"), "projections": (F.col("n_theta") * F.col("n_x") * F.col("n_z")).cast("long")})


def angles(scans: DataFrame, count: Column) -> DataFrame:
    """Per scan and t: theta_deg of ``count`` angles over half a turn, and the opposite one of the second half turn."""
    step = F.lit(180.0) / count
    rows = scans.withColumn("t", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))
    return rows.withColumns({"theta_deg": F.col("t") * step, "opposite_deg": F.col("t") * step + 180.0})


def diagonal_tiles(scans: DataFrame) -> DataFrame:
    """One tile per column along the diagonal of each mosaic, the row rounded half to even."""
    rows = with_tiles(scans).withColumn("xi", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1)))
    return rows.withColumn("zi", F.bround(F.col("xi") * (F.col("n_z") - 1) / F.greatest(F.lit(1), F.col("n_x") - 1), 0).cast("int"))


def magnification(r1: Column, r2: Column) -> Column:
    """Of a cone beam with the sample at r1 and the detector r2 behind it; a parallel beam has 1."""
    return (r1 + r2) / r1


def cone_column(x: Column, z: Column, r1: Column, r2: Column) -> Column:
    """Where on the detector a ray through (x, z) of the sample ends, z counted along the beam from the sample's centre."""
    return x * (r1 + r2) / (r1 + z)


def cone_spread(width: Column, thickness: Column, r1: Column) -> Column:
    """How far the outermost ray of a field of view moves sideways within a sample: its angle times the thickness."""
    return width / 2 / r1 * thickness
