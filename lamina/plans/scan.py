"""A whole scan, from a volume to its reconstruction through the mosaic: lazily composed operators, with the checks that can be
made before anything runs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import blocks, fbp, lines, model, mosaic, radon, resample, reshape, stats, stencil, stripe, wave
from lamina.operators.geometry import footprints, placements


@dataclass(frozen=True)
class Scan:
    """Sizes and physics of a scan. Defaults are those of the steps."""

    n: int
    nz: int
    angles: int
    energy_kev: float = 30.0
    voxel: float = 1.38e-6
    distance: float = 0.2
    beta_ratio: float = 100.0
    phase_scale: float = 1.0
    alpha: float = 5e-4
    filter: str = "ramp"
    dezinger: int = 0
    threshold: float = 1000.0
    sigma: float = 2.0
    wavelet: str = "sym16"
    level: int = 7
    #: Of the sample before it's measured: enlarged so many times, masked to a radius with a taper, faded over slices at its ends.
    factor: int = 1
    radius: float | None = None
    taper: float = 0.0
    fade: int = 0
    #: Bytes a task may hold: planes beyond it are worked on by strips.
    budget: int = blocks.BUDGET

    def __post_init__(self) -> None:
        if self.n % 2:
            raise ValueError("the size of a slice is even")
        if min(self.n, self.nz, self.angles) < 1:
            raise ValueError("sizes are positive")
        if self.n % self.factor or self.nz % self.factor:
            raise ValueError("sizes are those after enlarging, so the factor divides them")
        if self.filter not in fbp.FILTERS:
            raise ValueError(f"unknown filter {self.filter}")

    @property
    def norm(self) -> float:
        return math.sqrt(self.n / self.angles)


def enlarged(volume: DataFrame, n: int, factor: int) -> DataFrame:
    return resample.upsampled_z(resample.upsampled_planes(volume, n, factor), factor)


def prepared(volume: DataFrame, scan: Scan) -> DataFrame:
    """A sample (scan, z, y, x, v) as it's measured: enlarged, masked about its axis, and faded at both ends along it."""
    out = volume
    if scan.factor > 1:
        size, slices = scan.n // scan.factor, scan.nz // scan.factor
        planes = resample.upsampled_planes(together(out, "z", slices), size, scan.factor)
        # Slices of all scans are one axis here, and a scan's last one is repeated, not blended with the next scan's first.
        out = apart(planes, "z", slices)
        after = out.select("scan", (F.col("z") - 1).alias("z"), "y", "x", F.col("v").alias("_n"))
        steps = F.explode(F.sequence(F.lit(0), F.lit(scan.factor - 1)))
        both = out.join(after, ["scan", "z", "y", "x"], "left").withColumn("_r", steps).withColumn("_s", F.col("_r") / scan.factor)
        out = both.select("scan", (F.col("z") * scan.factor + F.col("_r")).cast("int").alias("z"), "y", "x", ((1 - F.col("_s")) * F.col("v") + F.col("_s") * F.coalesce("_n", "v")).alias("v"))
    if scan.radius is not None:
        out = out.withColumn("v", F.col("v") * reshape.circular_mask(F.col("y"), F.col("x"), scan.n, scan.radius, scan.taper))
    if scan.fade:
        out = out.withColumn("v", F.col("v") * reshape.z_weight(F.col("z"), 0, scan.nz, scan.fade))
    return out


# Each step holds a plane in a task where one fits the budget, and else works by strips.


def projections(volume: DataFrame, scan: Scan) -> DataFrame:
    """(t, z, x, v) of a volume (z, y, x, v)."""
    if blocks.fits_plane(2 * scan.n, 2 * scan.n, scan.budget):
        return radon.projected(volume, scan.angles)
    return blocks.projected(volume, scan.n, scan.angles, scan.budget)


def measured(volume: DataFrame, scan: Scan) -> DataFrame:
    """Intensities (t, z, x, v) behind a volume (z, y, x, v) after the distance."""
    return _propagated(projections(volume, scan), scan)


def _propagated(projections: DataFrame, scan: Scan) -> DataFrame:
    waves = wave.transmitted(projections, scan.norm, scan.beta_ratio, scan.phase_scale)
    if blocks.fits_plane(2 * scan.nz, 2 * scan.n, scan.budget):
        out = wave.propagated(waves, scan.distance, scan.voxel, scan.energy_kev)
    else:
        out = blocks.propagated(waves, scan.nz, scan.n, (scan.distance,), scan.voxel, scan.energy_kev, scan.budget)
    return out.select("t", "z", "x", wave.intensity(F.col("re"), F.col("im")).alias("v"))


def phases(stitched: DataFrame, scan: Scan) -> DataFrame:
    """Retrieved phases of intensities (t, z, x, v)."""
    if blocks.fits_plane(scan.nz, scan.n, scan.budget):
        return wave.retrieved(stitched, scan.distance, scan.alpha, scan.voxel, scan.energy_kev)
    return blocks.retrieved(stitched, scan.nz, scan.n, scan.distance, scan.alpha, scan.voxel, scan.energy_kev, scan.budget)


def reconstruction(phases: DataFrame, scan: Scan) -> DataFrame:
    """The volume (z, y, x, v) from phases (t, z, x, v)."""
    if blocks.fits_plane(2 * scan.n, 2 * scan.n, scan.budget):
        return fbp.reconstructed(phases, scan.filter)
    return blocks.reconstructed(phases, scan.n, scan.angles, scan.filter, scan.budget)


def tiled(stack: DataFrame, scans: DataFrame, scan: Scan) -> tuple[DataFrame, DataFrame]:
    """The mosaic's tiles of a stack (scan, t, z, x, v), and the catalog."""
    tiles = footprints(placements(scans))
    return mosaic.cut(stack, tiles, scan.angles), tiles


#: What tells tiles apart.
TILE = ("scan", "zi", "xi")


def corrected(tiles: DataFrame, scan: Scan, height: int, width: int, flat: DataFrame | None = None, dark: DataFrame | None = None) -> DataFrame:
    """Tiles (scan, zi, xi, t, z, x, v) of one size without outliers, divided by their own fields, and without stripes. flat and
    dark are each tile's frames, in the same columns with t counting frames; without them tiles are normalised already. Columns
    beside these, such as a tile's attributes, stay."""
    own = [c for c in tiles.columns if c not in (*TILE, "t", "z", "x", "v")]
    attributes = tiles.select(*TILE, *own).distinct() if own else None
    out = stencil.dezingered(tiles.select(*TILE, "t", "z", "x", "v"), scan.dezinger, scan.threshold, {"t": 2 * scan.angles, "x": width})
    if flat is not None and dark is not None:
        fields = [stencil.dezingered(f.select(*TILE, "t", "z", "x", "v"), scan.dezinger, scan.threshold, {"t": _frames(f), "x": width}) if scan.dezinger else f for f in (flat, dark)]
        out = stencil.flat_corrected(out, *fields, keys=(*TILE, "z", "x"))
    if scan.level:
        out = stripe.stripes_removed(out, scan.sigma, scan.wavelet, scan.level, (*TILE, "z"))
    return out.join(F.broadcast(attributes), list(TILE)) if own else out  # a row for each tile


def _frames(field: DataFrame) -> int:
    return (field.agg(F.max("t")).first()[0] or 0) + 1


def restored(stitched: DataFrame, scan: Scan) -> DataFrame:
    """The volume (z, y, x, v) from stitched intensities (t, z, x, v)."""
    return reconstruction(phases(stitched, scan), scan)


def together(values: DataFrame, axis: str, size: int) -> DataFrame:
    """Planes of all scans along one axis, as if they were one array's: for operators that work on each plane by itself."""
    return values.withColumn(axis, (F.col("scan") * size + F.col(axis)).cast("int")).drop("scan")


def apart(values: DataFrame, axis: str, size: int) -> DataFrame:
    """The inverse of together()."""
    return values.withColumns({"scan": F.floor(F.col(axis) / size).cast("int"), axis: (F.col(axis) % size).cast("int")})


def steps(volumes: DataFrame, scans: DataFrame, scan: Scan) -> dict[str, DataFrame]:
    """What each step of a scan gives, by name, the volumes again last: the sample as prepared, its projections, intensities, the
    mosaic's tiles, the corrected ones, the stitched stack, phases, and reconstruction. All of it is lazy; scans has each
    scan's geometry, with its n and nz those of the scan."""
    out = {"sample": prepared(volumes, scan)}
    out["projections"] = apart(projections(together(out["sample"], "z", scan.nz), scan), "z", scan.nz)
    out["intensities"] = apart(_propagated(together(out["projections"], "t", scan.angles), scan), "t", scan.angles)
    out["tiles"], catalog = tiled(out["intensities"], scans, scan)
    size = scans.agg(F.max("det_h"), F.max("det_w")).first()
    out["corrected"] = corrected(out["tiles"], scan, *size)
    stitched = mosaic.stitched(out["corrected"], catalog, scan.angles)
    # What no tile covers is air.
    full = scans.select("scan").crossJoin(model.grid(scans.sparkSession, t=scan.angles, z=scan.nz, x=scan.n))
    out["stitched"] = full.join(stitched, ["scan", "t", "z", "x"], "left").withColumn("v", F.coalesce("v", F.lit(1.0)))
    out["phases"] = apart(phases(together(out["stitched"], "t", scan.angles), scan), "t", scan.angles)
    out["volumes"] = apart(reconstruction(together(out["phases"], "z", scan.nz), scan), "z", scan.nz).select("scan", "z", "y", "x", "v")
    return out


def whole(volumes: DataFrame, scans: DataFrame, scan: Scan, keys: DataFrame | None = None) -> DataFrame:
    """Volumes (scan, z, y, x, v) again, after all steps(). With keys (scan), volumes have elements other than 0 only, or some
    of them, and these scans are done. Where planes fit the budget and no medians are asked for, whole lines go through the
    shuffles, not elements, and planes are worked on many at once: the same results but for rounding errors."""
    fits = blocks.fits_plane(2 * scan.n, 2 * scan.n, scan.budget) and blocks.fits_plane(2 * scan.nz, 2 * scan.n, scan.budget) and blocks.fits_plane(2 * scan.angles, scan.n, scan.budget)
    plain = scan.factor == 1 and scan.radius is None and not scan.fade
    if keys is not None and not (fits and plain and not scan.dezinger):
        full = keys.crossJoin(model.grid(keys.sparkSession, z=scan.nz // scan.factor, y=scan.n // scan.factor, x=scan.n // scan.factor))
        volumes, keys = full.join(volumes, ["scan", "z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)).cast("double")), None
    if not fits or scan.dezinger:
        return steps(volumes, scans, scan)["volumes"]
    if keys is None:
        slices = lines.gathered(prepared(volumes, scan), ["scan", "z"], ("y", "x"))
    else:
        every = keys.select("scan", F.explode(F.sequence(F.lit(0), F.lit(scan.nz - 1))).alias("z"))
        slices = lines.scattered(volumes, ["scan", "z"], ("y", "x"), (scan.n, scan.n), every)
    return _by_lines(slices, scans, scan)


def _by_lines(slices: DataFrame, scans: DataFrame, scan: Scan) -> DataFrame:
    """The steps in row form, from planes (scan, z, lines, v): each gathers the lines that it needs for its planes."""
    seen = lines.of_planes(slices, ["scan", "z"], radon.forward(scan.angles), "t")
    through = wave.measurement(scan.norm, scan.beta_ratio, scan.phase_scale, scan.distance, scan.voxel, scan.energy_kev)
    intensities = lines.of_planes(lines.stacked(seen, ["scan", "t"], "z"), ["scan", "t"], through, "z")
    catalog = footprints(placements(scans))
    out = mosaic.cut_lines(intensities, catalog, scan.angles)
    if scan.level:
        stripe.scaling(scan.wavelet)
        own = [*TILE, "z"]
        out = lines.of_planes(lines.stacked(out, own, "t"), own, stripe.removal(scan.sigma, scan.wavelet, scan.level), "t")
    stitched = mosaic.stitched_planes(out, catalog, scan.angles, scan.nz, scan.n)
    phases = lines.of_planes(stitched, ["scan", "t"], wave.retrieval(scan.distance, scan.alpha, scan.voxel, scan.energy_kev), "z")
    volumes = lines.of_planes(lines.stacked(phases, ["scan", "z"], "t"), ["scan", "z"], fbp.reconstruction(scan.filter), "y")
    return volumes.select("scan", "z", "y", F.posexplode("v").alias("x", "v"))


def statistics(found: dict[str, DataFrame]) -> DataFrame:
    """(step, scan, least, most, mean, n, has_nan) of what each step gave."""
    each = [stats.described(df, "scan").select(F.lit(name).alias("step"), "*") for name, df in found.items()]
    return reduce(DataFrame.unionByName, each)
