"""The imaging operators applied to arrays that are rasterised from the tables. Sizes of the arrays are fixed, their values are
aggregated from whole tables; operators on catalogs have a scan for each row of a table, and whole_scan one for every eight
suppliers."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import blocks, fbp, geometry, lines, model, mosaic, radon, resample, reshape, stats, stencil, stripe, wave
from lamina.plans import scan as scans
from lamina.sources import boxes, store, tiff

VOLUME = {"z": 8, "y": 16, "x": 16}
STACK = {"t": 12, "z": 8, "x": 16}
MOSAIC = {"scan": 4, "t": 4, "z": 24, "x": 40}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def volume(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("z"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_orderkey") % 16).cast("int").alias("x")).agg(F.sum("l_quantity").alias("v"))
    return model.filled(sums, VOLUME)


def stack(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 12).cast("int").alias("t"), (F.col("event_id") % 8).cast("int").alias("z"), (F.floor(F.col("event_id") / 8) % 16).cast("int").alias("x")).agg(F.count("*").cast("double").alias("v"))
    return model.filled(counts, STACK)


def part_scans(spark: SparkSession, d: str) -> DataFrame:
    """A scan for each part, the sample's size being the part's."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("scan"), F.lit(30).alias("det_h"), F.lit(40).alias("det_w"), F.lit(6).alias("overlap"), F.lit(5).alias("inset"), F.lit(7).alias("z_overlap"),
        (F.col("p_size") * 3.0).alias("sample_r"), (F.col("p_size") * 4.0 + F.col("p_partkey") % 7).alias("sample_h"), F.lit(320).alias("n"), F.lit(220).alias("nz"), F.lit(4).alias("z_pad"),
    )


def mosaic_stack(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).cast("int").alias("scan"), (F.col("l_linenumber") % 4).cast("int").alias("t"), (F.col("l_partkey") % 24).cast("int").alias("z"), (F.col("l_orderkey") % 40).cast("int").alias("x")).agg(F.sum("l_quantity").alias("v"))
    return model.filled(sums, MOSAIC)


def mosaic_scans(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "supplier").select((F.col("s_suppkey") % 4).cast("int").alias("scan")).distinct()
    return keys.select("scan", F.lit(12).alias("det_h"), F.lit(16).alias("det_w"), F.lit(4).alias("overlap"), F.lit(4).alias("inset"), F.lit(4).alias("z_overlap"), (F.col("scan") * 4 + 6.0).alias("sample_r"), F.lit(18.0).alias("sample_h"), F.lit(40).alias("n"), F.lit(24).alias("nz"), F.lit(3).alias("z_pad"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: model.rounded(c, digits) for c in columns or ("v",)})


def tiles_of(spark, d):
    return geometry.footprints(geometry.placements(mosaic_scans(spark, d)))


def stitch(spark, d):
    tiles = tiles_of(spark, d)
    pixels = mosaic.cut(mosaic_stack(spark, d), tiles, 4)
    return rounded(mosaic.uncovered_filled(mosaic.stitched(pixels, tiles, 4), MOSAIC))


TILE_COLUMNS = ("scan", "zi", "xi", "z_center", "x_center", "crop_top", "crop_bottom", "crop_left", "crop_right")


def tile_layout(spark, d):
    return geometry.placements(part_scans(spark, d)).select(*TILE_COLUMNS)


def mirror_placements(spark, d):
    return geometry.footprints(geometry.placements(part_scans(spark, d))).select("scan", "zi", "xi", *[F.col(c).cast("int").alias(c) for c in ("r_lo", "r_hi", "c_lo", "c_hi", "c_lo_mirror", "c_hi_mirror")])


def mosaic_summary(spark, d):
    return geometry.summary(part_scans(spark, d)).select("scan", "n_x", "n_z", F.col("fov_px").cast("int").alias("fov_px"), "covers", "projections", model.rounded(geometry.px_to_mm(F.col("fov_px"), geometry.pixel_um(F.lit(1)))).alias("fov_mm"))


def angle_grid(spark, d):
    return rounded(geometry.angles(part_scans(spark, d).select("scan", (F.pmod("scan", F.lit(16)) + 8).alias("count")), F.col("count")).select("scan", "t", "theta_deg", "opposite_deg"), "theta_deg", "opposite_deg")


def diag_tiles(spark, d):
    return geometry.diagonal_tiles(part_scans(spark, d)).select("scan", "xi", "zi")


def bank_plan(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"))
    return orders.groupBy(store.bank(F.col("i"), 1000, 8).alias("bank")).agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


def vchunk_iter(spark, d):
    shapes = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("n0"), (F.col("p_size") % 7 + 3).alias("n1"), (F.col("p_size") % 5 + 2).alias("n2"), F.lit(8).alias("c0"), F.lit(4).alias("c1"), F.lit(3).alias("c2"))
    return store.chunks(shapes).select("p_partkey", "i0", "i1", "i2", "s0", "s1", "s2", "position", "bytes")


def task_split(spark, d):
    ranges = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("low"), (F.col("p_size") * 3).cast("long").alias("high"), F.lit(4).alias("tasks"), F.lit(8).alias("align"))
    return store.task_ranges(ranges).select("p_partkey", "task", "task_low", "task_high")


def theta_slab(spark, d):
    return store.slab(stack(spark, d), "t", 3, 7)


def z_slab(spark, d):
    return store.slab(stack(spark, d), "z", 2, 5)


def dataset_info(spark, d):
    return store.shape(stack(spark, d), "t", "z", "x").select(*[F.col(c).cast("long").alias(c) for c in ("n_t", "n_z", "n_x", "rows")])


def center_crop(spark, d):
    return reshape.centred(volume(spark, d), VOLUME, {"y": 10, "x": 12})


def center_pad(spark, d):
    return reshape.centred(volume(spark, d), VOLUME, {"y": 20, "x": 18})


def circular_mask(spark, d):
    return rounded(volume(spark, d).withColumn("v", F.col("v") * reshape.circular_mask(F.col("y"), F.col("x"), 16, 6.0, 3.0)))


def z_taper(spark, d):
    return rounded(volume(spark, d).withColumn("v", F.col("v") * reshape.z_weight(F.col("z"), 1, 6, 2)))


def tile_extract_360(spark, d):
    tiles = tiles_of(spark, d)
    return mosaic.cut(mosaic_stack(spark, d), tiles, 4)


def fold_180(spark, d):
    return reshape.folded(stack(spark, d), 6)


def strided_slice(spark, d):
    return reshape.strided(volume(spark, d), z=2, x=3)


def symmetric_pad(spark, d):
    return reshape.mirror_padded(stack(spark, d), z=8, x=16)


def edge_pad(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("row"))
    return rounded(lines.exploded(vectors.select("vec_id", reshape.padded_rows(F.col("row"), 8, 8, "edge").alias("v")), ["vec_id"], "x", ("v",)))


def zero_pad(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("row"))
    return rounded(lines.exploded(vectors.select("vec_id", reshape.padded_rows(F.col("row"), 4, 4, "zero").alias("v")), ["vec_id"], "x", ("v",)))


def reflect_index(spark, d):
    return table(spark, d, "events").select("event_id", reshape.reflected((F.col("event_id") - 500).cast("int"), 37).alias("i"))


def upsample_xy(spark, d):
    return rounded(resample.upsampled_planes(volume(spark, d), 16, 2))


def upsample_z(spark, d):
    return rounded(resample.upsampled_z(volume(spark, d), 3))


def z_resample(spark, d):
    return rounded(resample.scaled_z(volume(spark, d), 8, 1.5, 13))


def nearest_repeat(spark, d):
    return resample.repeated(volume(spark, d), 2, "z", "x")


def bin2d(spark, d):
    return rounded(resample.block_means(stack(spark, d), 3, {"z": 8, "x": 16}))


def gaussian_smooth(spark, d):
    return rounded(resample.smoothed(volume(spark, d), 0.6, VOLUME))


def unsharp(spark, d):
    return rounded(resample.sharpened(volume(spark, d), 0.7, 0.6, VOLUME))


def psi_from_proj(spark, d):
    return rounded(wave.transmitted(stack(spark, d), 20.0), "re", "im")


def intensity(spark, d):
    waves = wave.transmitted(stack(spark, d), 20.0)
    return rounded(waves.select("t", "z", "x", wave.intensity(F.col("re"), F.col("im")).alias("v")))


def fresnel(spark, d):
    return rounded(wave.propagated(wave.transmitted(stack(spark, d), 20.0), 0.2), "re", "im", digits=5)


def paganin(spark, d):
    return rounded(wave.retrieved(stack(spark, d).withColumn("v", 0.5 + F.col("v") / 100), 0.2), digits=5)


def dezinger(spark, d):
    return rounded(stencil.dezingered(stack(spark, d), 3, 2.0, {"t": 12, "x": 16}))


def darkflat(spark, d):
    fields = stack(spark, d)
    flat = fields.where("t >= 6").select("z", "x", (F.col("v") + 100).alias("v"))
    return rounded(stencil.flat_corrected(fields, flat, fields.where("t < 6").select("z", "x", "v")))


def tent_weight(spark, d):
    tiles = tiles_of(spark, d)
    return mosaic.placed(mosaic.cut(mosaic_stack(spark, d), tiles, 4), tiles, 4).groupBy("scan", "t", "z", "x").agg(model.rounded(F.sum("w")).alias("w"), F.count("*").alias("n"))


def stack_stats(spark, d):
    return rounded(stats.described(stack(spark, d)), "mean")


def axis_mean(spark, d):
    return rounded(stats.axis_mean(stack(spark, d), "t"))


def percentile_clip(spark, d):
    return rounded(stats.clip_range(table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).cast("int").alias("z"), F.col("l_extendedprice").alias("v")), 0.01, 0.99, "z"), "low", "high", digits=4)


def rel_error(spark, d):
    v = volume(spark, d)
    return rounded(stats.errors(v, reshape.flipped(v, "x", 16), "z", "y", "x"), "rel_max", "rel_l2", "inner")


def stage_throughput(spark, d):
    tasks = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("bytes"), F.col("l_quantity").alias("seconds"))
    return rounded(stats.throughput(tasks, "l_returnflag", "l_linestatus"), "rate", "slowest", "fastest", digits=9)


def human_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", stats.human_bytes((F.col("o_orderkey") * F.col("o_custkey")).cast("long")).alias("size"))


def sample_points(spark, d, n: int = 8) -> DataFrame:
    """Where the lines of the angles that users have are sampled."""
    angles = table(spark, d, "events").select((F.col("user_id") % 6).cast("int").alias("t")).distinct()
    return radon.samples(angles.select("t", (F.col("t") * (math.pi / 6)).alias("theta")), n)


def nufft_gather(spark, d):
    spectrum = volume(spark, d).select("z", F.col("y").alias("ky"), F.col("x").alias("kx"), F.col("v").alias("re"), (F.col("v") * 0.5).alias("im"))
    return rounded(radon.gathered(spectrum, sample_points(spark, d), 8), "re", "im", digits=2)


def nufft_scatter(spark, d):
    values = stack(spark, d).select("z", "t", F.col("x").alias("r"), F.col("v").alias("re"), (F.col("v") * 0.5).alias("im"))
    angles = table(spark, d, "events").select((F.col("user_id") % 12).cast("int").alias("t")).distinct()
    points = radon.samples(angles.select("t", (F.col("t") * (math.pi / 12)).alias("theta")), 16)
    return rounded(radon.scattered(values, points, 16), "re", "im", digits=2)


def kx_bins(spark, d):
    return radon.bins(sample_points(spark, d), 8, 3)


def ky_bands(spark, d):
    return radon.bands(sample_points(spark, d), 8, 4).groupBy("band").agg(F.count("*").alias("n"))


def radon_forward(spark, d):
    return rounded(radon.projected(volume(spark, d), 12), digits=3)


def radon_adjoint(spark, d):
    return rounded(radon.back_projected(stack(spark, d)), digits=5)


def fbp_filter(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(lines.exploded(lines.mapped(vectors, ["vec_id"], fbp.filtered_lines("shepp")), ["vec_id"], "x", ("v",)), digits=3)


def fbp_reconstruction(spark, d):
    return rounded(fbp.reconstructed(stack(spark, d)), digits=3)


def stripe_removal(spark, d):
    return rounded(stripe.stripes_removed(stack(spark, d), 2.0, "haar", 2), digits=5)


#: A budget that cuts even these planes into several strips.
STRIP = 20_000


def radon_by_lines(spark, d):
    return rounded(blocks.projected(volume(spark, d), 16, 12, STRIP), digits=3)


def radon_adjoint_by_lines(spark, d):
    return rounded(blocks.back_projected(stack(spark, d), 16, 12, STRIP), digits=5)


def paganin_by_lines(spark, d):
    return rounded(blocks.retrieved(stack(spark, d).withColumn("v", 0.5 + F.col("v") / 100), 8, 16, 0.2, budget=5_000), digits=5)


def fbp_by_lines(spark, d):
    return rounded(blocks.reconstructed(stack(spark, d), 16, 12, budget=STRIP), digits=3)


def fresnel_distances(spark, d):
    """Two distances from one reading of the waves, by strips."""
    waves = wave.transmitted(stack(spark, d), 20.0)
    return rounded(blocks.propagated(waves, 8, 16, (0.2, 0.7), budget=5_000), "re", "im", digits=5)


def stripes_by_strips(spark, d):
    return rounded(stripe.stripes_removed_by_strips(stack(spark, d), 12, 16, 2.0, "haar", 2, budget=4_000), digits=5)


def radon_multiplier(spark, d):
    return volume(spark, d).select("z", "y", "x", model.rounded(F.col("v") * radon.multiplier(16, 12), 9).alias("v"))


def stitch_uneven(spark, d):
    """Tiles that each have a level of their own: what their weights are decides the result."""
    tiles = tiles_of(spark, d)
    pixels = mosaic.cut(mosaic_stack(spark, d), tiles, 4).withColumn("v", F.col("v") + 100 * F.col("zi") + 10 * F.col("xi") + F.when(F.col("t") >= 4, 5).otherwise(0))
    return rounded(mosaic.uncovered_filled(mosaic.stitched(mosaic.checked(pixels, tiles), tiles, 4), MOSAIC))


def tile_files(spark, d):
    """Tiles written, a folder each, and read again by the catalog."""
    tiles = tiles_of(spark, d)
    path = store.scratch(spark)
    store.write_tiles(mosaic.cut(mosaic_stack(spark, d), tiles, 4), path)
    return store.read_tiles(spark, path, tiles.where("zi <= xi")).groupBy("scan", "zi", "xi").agg(F.count("*").alias("n"), model.rounded(F.sum("v")).alias("total"))


def store_box(spark, d):
    """A stack written by bands, written again over it, and a box of it read: bands outside aren't opened."""
    path = store.scratch(spark)
    store.write(stack(spark, d).withColumn("v", F.col("v") + 1), path, "slice", band=2)
    store.write(stack(spark, d), path, "slice", band=2)
    return store.read(spark, path, "z", 3, 7, band=2).where("x >= 4 and x < 9").select("t", "z", "x", "v")


def store_range(spark, d):
    path = store.scratch(spark)
    store.write(stack(spark, d), path, "proj", band=4)
    return store.read(spark, path, "t", 5, 10, band=4).select("t", "z", "x", "v")


def store_boxes(spark, d):
    """Embeddings as elements (vector, label, component) laid out in boxes: the whole, a range of each axis and a box read again."""
    path, layout = store.scratch(spark), boxes.Boxes((("t", 1024), ("z", 2), ("x", 16)), levels=1)
    elements = table(spark, d, "embeddings").select(F.col("vec_id").alias("t"), F.col("label").alias("z"), F.posexplode("embedding").alias("x", "v"))
    boxes.write(elements.withColumn("v", F.col("v").cast("double")), path, layout)
    ranges = {"t": (200, None), "z": (3, 7), "x": (16, 40)}
    read = {"whole": {}, **{a: {a: r} for a, r in ranges.items()}, "box": ranges}
    parts = [boxes.read(spark, path, r, layout).withColumn("part", F.lit(name)) for name, r in read.items()]
    return rounded(reduce(DataFrame.unionByName, parts).groupBy("part", "z", "x").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", digits=3)


def bank_files(spark, d):
    """A stack in bank files: of chunks of 5 projections in 2 banks."""
    path = store.scratch(spark)
    store.write_banks(stack(spark, d), path, "proj", 5, 2)
    return spark.read.parquet(path).groupBy("bank").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), F.sum("v").alias("total"))


def tiff_pages(spark, d):
    """A page for each supplier, written as files of pages and read again: of all pages but the first the lines from 4 to 11."""
    path = store.scratch(spark)
    last = table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0]
    sums = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("z"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_orderkey") % 16).cast("int").alias("x")).agg(F.sum("l_quantity").alias("v"))
    tiff.write(model.to_rows(model.filled(sums, {"z": (last or 0) + 1, "y": 16, "x": 16}), "z", "y"), path)
    some = tiff.read(spark, path).where("z >= 1 and y >= 4 and y < 12")
    return rounded(model.to_long(some, "z", "y").withColumn("v", F.col("v").cast("double")), digits=3)


def catalog_text(spark, d):
    """The catalog written as text and parsed again."""
    header = dict(NZ=24, N=40, DET_H=12, DET_W=16, n_z=2, n_x=2, NTHETA=8, N_HALF=4, OVERLAP=4)
    path = store.scratch(spark)
    store.catalog_lines(geometry.placements(part_scans(spark, d).withColumn("scan", F.lit(0))).distinct(), header).write.text(path)
    found, rows = store.read_catalog(spark.read.text(path))
    return rows.select(*store.CATALOG_COLUMNS, F.lit(found["N_HALF"]).alias("half"), "overlap").distinct()


def tile_index(spark, d):
    """Tiles by their file names; names that aren't such are left out."""
    names = table(spark, d, "part").select(F.concat(F.lit("/a/"), F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_size").cast("string")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".h5")).alias("path"))
    return store.tile_names(names).select("zi", "xi")


def rectangle(spark, d):
    return reshape.rectangle(volume(spark, d), y=(3, 11), x=(2, 15))


def sharp_mask(spark, d):
    return volume(spark, d).withColumn("v", F.col("v") * reshape.circular_mask(F.col("y"), F.col("x"), 16, 6.0, 0.0))


def zoom_xy(spark, d):
    return rounded(resample.zoomed_axis(resample.zoomed_axis(volume(spark, d), "x", 16, 23), "y", 16, 21))


def millimetres(spark, d):
    """Pixels as millimetres and back, at each part's upsampling."""
    pixel = geometry.pixel_um(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", model.rounded(geometry.px_to_mm(F.col("p_retailprice"), pixel), 9).alias("mm"), model.rounded(geometry.mm_to_px(geometry.px_to_mm(F.col("p_retailprice"), pixel), pixel)).alias("px"), model.rounded(geometry.mm_to_px(F.col("p_retailprice"), pixel), 3).alias("of_mm"))


def standard_geometry(spark, d):
    """Scan parameters by upsampling, with the padding above the sample."""
    ups = table(spark, d, "part").select(F.col("p_size").alias("ups")).distinct()
    return geometry.standard_scans(ups).select("ups", *[F.col(c).cast("int").alias(c) for c in ("det_h", "det_w", "overlap", "nz", "z_pad")], "sample_r", "sample_h")


def cone_geometry(spark, d):
    r1, r2 = F.lit(50_000.0), F.col("p_size") * 100.0
    return table(spark, d, "part").select(
        "p_partkey", model.rounded(geometry.magnification(r1, r2), 9).alias("magnification"), model.rounded(geometry.cone_column(F.col("p_size") / 10.0, F.col("p_partkey") % 31 - 15.0, r1, r2), 9).alias("x_det"),
        model.rounded(geometry.cone_spread(F.lit(4.46), F.col("p_size") * 1.0, r1), 9).alias("spread"),
    )


def fresnel_numbers(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return parts.select("p_partkey", F.round(F.expr(f"{wave.fresnel_number(1.38e-6, 30.0, 1.0)!r}d") / (F.col("p_size") / 100.0), 6).alias("number"))


def strip_order(spark, d):
    return radon.in_strip_order(sample_points(spark, d), 8, 3).select("bin", F.col("place").cast("int").alias("place"), "t", "r")


def theta_prefix(spark, d):
    """The first half of the angles, with each projection's angle attached."""
    angles = geometry.angles(spark.range(1).select(F.lit(12).alias("count")), F.col("count")).select("t", "theta_deg").where("t < 6")
    return rounded(stack(spark, d).join(F.broadcast(angles), "t"), "theta_deg").select("t", "z", "x", "v", "theta_deg")  # a row for each angle


def line_callback(spark, d):
    """A callback on each line: its running sum, and its differences."""
    import numpy as np

    sums = lines.along(stack(spark, d), "x", ["t", "z"], lambda v: (np.cumsum(v, axis=1),)).withColumnRenamed("v", "total")
    steps = lines.along(stack(spark, d), "x", ["t", "z"], lambda v: (np.diff(v, axis=1, prepend=0.0),)).withColumnRenamed("v", "step")
    return rounded(sums.join(steps, ["t", "z", "x"]), "total", "step")


def plane_callback(spark, d):
    """A callback on each plane: its sums along one axis."""

    def fn(at, plane):
        return {"x": list(range(plane["v"].shape[1])), "v": plane["v"].sum(0)}

    return rounded(lines.planes(stack(spark, d), ["z"], ("t", "x"), fn, "z int, x int, v double"))


def cast_single(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 8).cast("int").alias("z")).agg(model.rounded(F.sum(F.col("l_extendedprice").cast("float").cast("double")), 3).alias("total"), F.max(F.col("l_tax").cast("float").cast("double")).alias("most"))


def wavelet_bands(spark, d):
    """One level of a Haar transform along each line: half as many averages and details."""

    def fn(v):
        low, high, *_ = stripe.filters("haar")
        a, b = stripe.analysed(v, low, high, 1)
        return a, b

    def bands(v):
        a, b = fn(v)
        return a, b, stripe.synthesised(a, b, *stripe.filters("haar")[2:], 1)[:, : v.shape[1]][:, ::2]

    found = lines.along(stack(spark, d).withColumns({"d": F.col("v"), "again": F.col("v")}), "x", ["t", "z"], lambda v, _, __: bands(v), ("v", "d", "again"))
    return rounded(found, "v", "again").withColumn("d", model.rounded(F.abs("d")))


def block_plan(spark, d):
    """How many lines of each part's arrays a task should hold."""
    sizes = table(spark, d, "part").select("p_size").distinct().orderBy("p_size").collect()  # 50 sizes
    return spark.createDataFrame([(r.p_size, lines.block_size(r.p_size * 12, r.p_size * 1000, 200_000)) for r in sizes], "p_size int, lines int").join(table(spark, d, "part").groupBy("p_size").count(), "p_size")


def corrected_tiles(spark, d):
    """The correction of tiles: outliers, then stripes, of each tile of one size."""
    scan = scans.Scan(n=16, nz=8, angles=6, dezinger=3, threshold=2.0, wavelet="haar", level=2)
    tiles = stack(spark, d).withColumns({"scan": F.lit(0), "zi": F.lit(0), "xi": F.lit(0)})
    return rounded(scans.corrected(tiles, scan, 8, 16).select("t", "z", "x", "v"), digits=5)


def whole_scan(spark, d):
    """Volumes, measurement, tiles, correction, stitching, phase retrieval and reconstruction: a scan for every eight suppliers."""
    scan = scans.Scan(n=16, nz=8, angles=12)
    keys = table(spark, d, "supplier").select(F.floor(F.col("s_suppkey") / 8).cast("int").alias("scan")).distinct()
    sums = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_suppkey") / 8).cast("int").alias("scan"), (F.col("l_suppkey") % 8).cast("int").alias("z"), (F.col("l_partkey") % 16).cast("int").alias("y"), (F.col("l_orderkey") % 16).cast("int").alias("x")).agg(F.sum("l_quantity").alias("v"))
    volumes = sums.withColumn("v", F.col("v").cast("double") / 1e4)
    geometries = keys.select("scan", F.lit(5).alias("det_h"), F.lit(6).alias("det_w"), F.lit(2).alias("overlap"), F.lit(2).alias("inset"), F.lit(2).alias("z_overlap"), F.lit(8.0).alias("sample_r"), F.lit(8.0).alias("sample_h"), F.lit(16).alias("n"), F.lit(8).alias("nz"), F.lit(0).alias("z_pad"))
    return rounded(scans.whole(volumes, geometries, scan, keys), digits=3)


_VOLUME = """vol AS (SELECT g.z, g.y, g.x, coalesce(s.v, 0.0)::DOUBLE AS v FROM (SELECT a.range::INT AS z, b.range::INT AS y, c.range::INT AS x FROM range(8) a, range(16) b, range(16) c) g
LEFT JOIN (SELECT (l_suppkey % 8)::INT AS z, (l_partkey % 16)::INT AS y, (l_orderkey % 16)::INT AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) s USING (z, y, x))"""
_STACK = """st AS (SELECT g.t, g.z, g.x, coalesce(s.v, 0.0)::DOUBLE AS v FROM (SELECT a.range::INT AS t, b.range::INT AS z, c.range::INT AS x FROM range(12) a, range(8) b, range(16) c) g
LEFT JOIN (SELECT (user_id % 12)::INT AS t, (event_id % 8)::INT AS z, ((event_id // 8) % 16)::INT AS x, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2, 3) s USING (t, z, x))"""
_PARTS = """sc AS (SELECT p_partkey AS scan, 30 AS det_h, 40 AS det_w, 6 AS overlap, 5 AS inset, 7 AS z_overlap, p_size * 3.0::DOUBLE AS r, p_size * 4.0::DOUBLE + p_partkey % 7 AS h, 320 AS n, 220 AS nz, 4 AS z_pad FROM part)"""
_LAYOUT = """ly AS (SELECT *, CASE WHEN det_w - inset >= r THEN 1 ELSE ceil((r - (det_w - inset)) / (det_w - overlap)) + 1 END::INT AS n_x, CASE WHEN h <= det_h THEN 1 ELSE ceil((h - det_h) / (det_h - z_overlap)) + 1 END::INT AS n_z FROM sc),
tl AS (SELECT ly.* EXCLUDE (zi), zi::INT AS zi, xi::INT AS xi, round_even((zi * (det_h - z_overlap) - (n_z * det_h - (n_z - 1) * z_overlap - h) / 2.0)::DOUBLE, 0)::INT + z_pad AS z0, xi::INT * (det_w - overlap) - inset + n // 2 AS x0
FROM (SELECT *, unnest(range(n_z)) AS zi FROM ly) ly, LATERAL (SELECT unnest(range(ly.n_x)) AS xi)),
pl AS (SELECT *, z0 + det_h // 2 AS z_center, x0 + det_w // 2 AS x_center, greatest(0, -z0) AS crop_top, greatest(0, z0 + det_h - nz) AS crop_bottom, greatest(0, -x0) AS crop_left, greatest(0, x0 + det_w - n) AS crop_right FROM tl),
fp AS (SELECT *, z0 + crop_top AS r_lo, z0 + det_h - crop_bottom AS r_hi, x0 + crop_left AS c_lo, x0 + det_w - crop_right AS c_hi, n - x_center - det_w // 2 + crop_right AS c_lo_mirror, n - x_center - det_w // 2 + det_w - crop_left AS c_hi_mirror FROM pl)"""
_MOSAIC = """sc AS (SELECT DISTINCT (s_suppkey % 4)::INT AS scan, 12 AS det_h, 16 AS det_w, 4 AS overlap, 4 AS inset, 4 AS z_overlap, (s_suppkey % 4) * 4 + 6.0::DOUBLE AS r, 18.0::DOUBLE AS h, 40 AS n, 24 AS nz, 3 AS z_pad FROM supplier),
ms AS (SELECT g.scan, g.t, g.z, g.x, coalesce(s.v, 0.0)::DOUBLE AS v FROM (SELECT e.range::INT AS scan, a.range::INT AS t, b.range::INT AS z, c.range::INT AS x FROM range(4) e, range(4) a, range(24) b, range(40) c) g
LEFT JOIN (SELECT (l_suppkey % 4)::INT AS scan, (l_linenumber % 4)::INT AS t, (l_partkey % 24)::INT AS z, (l_orderkey % 40)::INT AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4) s USING (scan, t, z, x)), """ + _LAYOUT
_SIDES = """px AS (SELECT m.scan, fp.zi, fp.xi, m.t AS t, m.z - r_lo AS z, m.x - c_lo AS x, m.v, m.t AS ot, m.z AS oz, m.x AS ox, r_hi - r_lo AS hh, c_hi - c_lo AS ww FROM ms m JOIN fp ON m.scan = fp.scan AND m.z >= r_lo AND m.z < r_hi AND m.x >= c_lo AND m.x < c_hi
UNION ALL SELECT m.scan, fp.zi, fp.xi, m.t + 4, m.z - r_lo, c_hi_mirror - 1 - m.x, m.v, m.t, m.z, m.x, r_hi - r_lo, c_hi - c_lo FROM ms m JOIN fp ON m.scan = fp.scan AND m.z >= r_lo AND m.z < r_hi AND m.x >= c_lo_mirror AND m.x < c_hi_mirror)"""
_TAPS = """pt AS (SELECT t, r, (r - 4) / 8.0 * cos(t * (pi() / 6)) AS x0, -(r - 4) / 8.0 * sin(t * (pi() / 6)) AS y0 FROM (SELECT DISTINCT (user_id % 6)::INT AS t FROM events) a, (SELECT range::INT AS r FROM range(8)) b),
tp AS (SELECT t, r, ((ly % 16) + 16) % 16 AS ky, ((lx % 16) + 16) % 16 AS kx, (pi() / mu) * exp(-(pi() * pi()) / mu * ((lx / 16.0 - x0) * (lx / 16.0 - x0) + (ly / 16.0 - y0) * (ly / 16.0 - y0))) * (1 - 2 * (abs(lx + ly) % 2)) AS w
FROM (SELECT *, -ln(1e-3) / 128 AS mu, round_even(16 * x0, 0)::INT - 4 + a.range::INT AS lx, round_even(16 * y0, 0)::INT - 4 + b.range::INT AS ly FROM pt, range(9) a, range(9) b))"""
_GAUSS = """k AS (SELECT d, exp(-0.5 * (d / 0.6) * (d / 0.6)) / sum(exp(-0.5 * (d / 0.6) * (d / 0.6))) OVER () AS w FROM (SELECT range::INT - 2 AS d FROM range(5))),
g1 AS (SELECT vol.z, vol.y, vol.x + d AS x, sum(v * w) AS v FROM vol, k WHERE vol.x + d BETWEEN 0 AND 15 GROUP BY 1, 2, 3), g2 AS (SELECT z, g1.y + d AS y, x, sum(v * w) AS v FROM g1, k WHERE g1.y + d BETWEEN 0 AND 15 GROUP BY 1, 2, 3),
g3 AS (SELECT g2.z + d AS z, y, x, sum(v * w) AS v FROM g2, k WHERE g2.z + d BETWEEN 0 AND 7 GROUP BY 1, 2, 3)"""
_ZOOM = """o AS (SELECT range::INT AS o, range * 15.0::DOUBLE / 31 AS s FROM range(32)), tap AS (SELECT o, floor(s)::INT AS i, 1 - (s - floor(s)) AS w FROM o UNION ALL SELECT o, floor(s)::INT + 1, s - floor(s) FROM o WHERE floor(s) < 15)"""


def _r(expression: str, name: str = "v", digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def _kernel(name: str, n: int, distance: float = 0.2) -> str:
    """The propagation kernel along an axis of n samples, mirrored to 2n, by an explicit transform."""
    f = f"(CASE WHEN m.range < {n} THEN m.range ELSE m.range - {2 * n} END / ({2 * n} * 1.38e-6))"
    phase = f"(-pi() * (1.24e-9 / 30.0) * {distance} * {f} * {f} + 2 * pi() * m.range * d.range / {2 * n})"
    return f"{name} AS (SELECT d.range::INT AS d, sum(cos({phase})) / {2 * n} AS hr, sum(sin({phase})) / {2 * n} AS hi FROM range({2 * n}) d, range({2 * n}) m GROUP BY 1)"


def _propagated(source: str, axis: str, other: str, kernel: str, n: int) -> str:
    """A pass along an axis: each output is the sum over the mirrored line of the kernel times the wave."""
    mirrored = f"CASE WHEN j.range < {n // 2} THEN {n // 2} - 1 - j.range WHEN j.range >= {3 * n // 2} THEN {2 * n + n // 2} - 1 - j.range ELSE j.range - {n // 2} END"
    return (
        f"(SELECT t, {other}, k.range::INT AS {axis}, sum(hr * re - hi * im) AS re, sum(hr * im + hi * re) AS im FROM {source} s JOIN range({2 * n}) j ON s.{axis} = {mirrored}, range({n}) k "
        f"JOIN {kernel} h ON h.d = (k.range + {n // 2} - j.range + {2 * n}) % {2 * n} GROUP BY 1, 2, 3)"
    )


def _taps(n: int, angles: int) -> str:
    """Points of all samples, and their taps: columns t, r, ky, kx, w."""
    mu, reach = radon.taps(n)
    return f"""pn AS (SELECT a.range::INT AS t, b.range::INT AS r, (b.range - {n // 2}) / {n}.0 * cos(a.range * (pi() / {angles})) AS x0, -(b.range - {n // 2}) / {n}.0 * sin(a.range * (pi() / {angles})) AS y0 FROM range({angles}) a, range({n}) b),
tn AS MATERIALIZED (SELECT t, r, ((ly % {2 * n}) + {2 * n}) % {2 * n} AS ky, ((lx % {2 * n}) + {2 * n}) % {2 * n} AS kx, (pi() / mu) * exp(-(pi() * pi()) / mu * ((lx / {2 * n}.0 - x0) * (lx / {2 * n}.0 - x0) + (ly / {2 * n}.0 - y0) * (ly / {2 * n}.0 - y0))) * (1 - 2 * (abs(lx + ly) % 2)) AS w
FROM (SELECT *, {mu!r}::DOUBLE AS mu, round_even({2 * n} * x0, 0)::INT - {reach} + a.range::INT AS lx, round_even({2 * n} * y0, 0)::INT - {reach} + b.range::INT AS ly FROM pn, range({2 * reach + 1}) a, range({2 * reach + 1}) b))"""


def _multiplier(n: int, angles: int) -> str:
    mu, _ = radon.taps(n)
    at = lambda k: f"(({k} - {n // 2}) / {n}.0) * (({k} - {n // 2}) / {n}.0)"
    return f"exp({mu!r}::DOUBLE * {n * n} * ({at('y')} + {at('x')})) * {(1 if n % 4 == 0 else -1) / (n * math.sqrt(n * angles))!r}::DOUBLE"


def _forward(source: str, n: int, angles: int) -> str:
    """fw: projections by explicit transforms along x and y, the taps, and an explicit transform back."""
    a = lambda k, x: f"2 * pi() * {k} * ({x} + {n // 2}) / {2 * n}.0"
    back = f"2 * pi() * (r - {n // 2}) * (x.range - {n // 2}) / {n}.0"
    return f"""im AS (SELECT z, y, x, v * {_multiplier(n, angles)} AS v FROM {source}), fx AS MATERIALIZED (SELECT z, y, k.range AS kx, sum(v * cos({a('k.range', 'x')})) AS re, -sum(v * sin({a('k.range', 'x')})) AS im FROM im, range({2 * n}) k GROUP BY 1, 2, 3),
fy AS MATERIALIZED (SELECT z, k.range AS ky, kx, sum(re * cos({a('k.range', 'y')}) + im * sin({a('k.range', 'y')})) AS re, sum(im * cos({a('k.range', 'y')}) - re * sin({a('k.range', 'y')})) AS im FROM fx, range({2 * n}) k GROUP BY 1, 2, 3),
ga AS MATERIALIZED (SELECT z, t, r, sum(w * re) / {n} AS re, sum(w * im) / {n} AS im FROM tn JOIN fy USING (ky, kx) GROUP BY 1, 2, 3), fw AS (SELECT t, z, x.range::INT AS x, sum(re * cos({back}) - im * sin({back})) / {4 * n} AS v FROM ga, range({n}) x GROUP BY 1, 2, 3)"""


def _adjoint(source: str, n: int, angles: int) -> str:
    """ad: the transpose of _forward(), by explicit transforms as well."""
    forth = f"2 * pi() * (x - {n // 2}) * (r.range - {n // 2}) / {n}.0"
    a = lambda k, o: f"2 * pi() * {k} * ({o} + {n // 2}) / {2 * n}.0"
    return f"""li AS MATERIALIZED (SELECT z, t, r.range AS r, sum(v * cos({forth})) / {4 * n * n} AS re, -sum(v * sin({forth})) / {4 * n * n} AS im FROM {source}, range({n}) r GROUP BY 1, 2, 3),
sc AS MATERIALIZED (SELECT z, ky, kx, sum(w * re) AS re, sum(w * im) AS im FROM tn JOIN li USING (t, r) GROUP BY 1, 2, 3),
bk AS MATERIALIZED (SELECT z, o.range AS y, kx, sum(re * cos({a('ky', 'o.range')}) - im * sin({a('ky', 'o.range')})) AS re, sum(im * cos({a('ky', 'o.range')}) + re * sin({a('ky', 'o.range')})) AS im FROM sc, range({n}) o GROUP BY 1, 2, 3),
bx AS (SELECT z, y, o.range AS x, sum(re * cos({a('kx', 'o.range')}) - im * sin({a('kx', 'o.range')})) AS v FROM bk, range({n}) o GROUP BY 1, 2, 3), ad AS (SELECT z::INT AS z, y::INT AS y, x::INT AS x, v * {_multiplier(n, angles)} AS v FROM bx)"""


def _filter_kernel(name: str, n: int) -> str:
    """fk: the filter as a kernel over a line of 4n, from its weights."""
    w = ", ".join(repr(float(x)) for x in fbp.weights(name, n))
    return f"fk AS MATERIALIZED (SELECT d.range::INT AS d, sum(([{w}]::DOUBLE[])[1 + CASE WHEN k.range <= {2 * n} THEN k.range ELSE {4 * n} - k.range END] * cos(2 * pi() * k.range * d.range / {4 * n}.0)) / {4 * n} AS g FROM range({4 * n}) d, range({4 * n}) k GROUP BY 1)"


def _filtered(n: int) -> str:
    """fl: lines (t, z, x) of st filtered; their ends are continued."""
    at = f"(o.range + {3 * n // 2} - j.range + {4 * n}) % {4 * n}"
    return f"km AS MATERIALIZED (SELECT o.range::INT AS o, least({n - 1}, greatest(0, j.range - {3 * n // 2}))::INT AS i, sum(g) AS g FROM range({n}) o, range({4 * n}) j JOIN fk ON d = {at} GROUP BY 1, 2), fl AS MATERIALIZED (SELECT t, z, o AS x, sum(v * g) AS v FROM st JOIN km ON x = i GROUP BY 1, 2, 3)"


def _unstriped(source: str) -> str:
    """us: a sinogram of 12 angles without its stripes, two levels of Haar bands. A band that is left out is taken from what it
    was made of; the band along the angles has 7 and 4 lines, the last of which reach beyond the end."""

    def kept(name: str, m: int) -> str:
        c = "exp(-pow(" + ("least(k.range, %d - k.range)" % m if m % 2 else "least(k.range + 0.5, %d - k.range - 0.5)" % m) + ", 2) / 8.0)"
        if not m % 2:  # the upper half mirrors the lower one
            c = f"exp(-pow(CASE WHEN k.range <= {m // 2} THEN least(k.range + 0.5, {m} - k.range - 0.5) ELSE least({m} - k.range + 0.5, k.range - 0.5) END, 2) / 8.0)"
        return f"{name} AS (SELECT d.range::INT AS d, sum({c} * cos(2 * pi() * k.range * d.range / {m}.0)) / {m} AS p FROM range({m}) d, range({m}) k GROUP BY 1)"

    return f"""{kept('p1', 7)}, {kept('p2', 4)}, v1 AS (SELECT a.range::INT AS t, z.range::INT AS z, x.range::INT AS x, coalesce(v, 0.0) AS v FROM range(14) a, range(8) z, range(16) x LEFT JOIN {source} s ON s.t = a.range AND s.z = z.range AND s.x = x.range),
h1 AS (SELECT t // 2 AS t, z, x // 2 AS x, sum(v * (1 - 2 * (x % 2))) / 2 AS h, sum(v) / 2 AS l FROM v1 GROUP BY 1, 2, 3), r1 AS (SELECT o.range::INT AS t, z, x, sum(h * p) AS r FROM h1, range(7) o, p1 WHERE d = (o.range - t + 7) % 7 GROUP BY 1, 2, 3),
v2 AS (SELECT t, z, x, l FROM h1 UNION ALL SELECT 7, z, x, l FROM h1 WHERE t = 6), h2 AS (SELECT t // 2 AS t, z, x // 2 AS x, sum(l * (1 - 2 * (x % 2))) / 2 AS h FROM v2 GROUP BY 1, 2, 3), r2 AS (SELECT o.range::INT AS t, z, x, sum(h * p) AS r FROM h2, range(4) o, p2 WHERE d = (o.range - t + 4) % 4 GROUP BY 1, 2, 3),
us AS (SELECT s.t, s.z, s.x, s.v - (1 - 2 * (s.x % 2)) * r1.r / 2 - (1 - 2 * ((s.x // 2) % 2)) * r2.r / 4 AS v FROM {source} s JOIN r1 ON r1.t = s.t // 2 AND r1.z = s.z AND r1.x = s.x // 2 JOIN r2 ON r2.t = s.t // 4 AND r2.z = s.z AND r2.x = s.x // 4)"""


_DEZINGER = "dz AS MATERIALIZED (SELECT c.t, c.z, c.x, any_value(c.v) AS v, median(s.v) AS md FROM st c, range(9) k, st s WHERE s.z = c.z AND s.t = CASE WHEN c.t + k.range // 3 - 1 < 0 THEN 0 WHEN c.t + k.range // 3 - 1 > 11 THEN 11 ELSE c.t + k.range // 3 - 1 END AND s.x = CASE WHEN c.x + k.range % 3 - 1 < 0 THEN 0 WHEN c.x + k.range % 3 - 1 > 15 THEN 15 ELSE c.x + k.range % 3 - 1 END GROUP BY 1, 2, 3), dd AS (SELECT t, z, x, CASE WHEN v - md > 2.0 THEN md ELSE v END AS v FROM dz)"


def _zoom(name: str, size: int, target: int) -> str:
    return f"{name}_o AS (SELECT range::INT AS o, range * {float(size - 1)}::DOUBLE / {target - 1} AS s FROM range({target})), {name} AS (SELECT o, floor(s)::INT AS i, 1 - (s - floor(s)) AS w FROM {name}_o UNION ALL SELECT o, floor(s)::INT + 1, s - floor(s) FROM {name}_o WHERE floor(s) < {size - 1})"


_SINE = "(0.5 - 0.5 * cos(pi() * {}))"

ORACLE_SQL = {
    "tile_layout": f"WITH {_PARTS}, {_LAYOUT} SELECT scan, zi, xi, z_center, x_center, crop_top, crop_bottom, crop_left, crop_right FROM pl",
    "mirror_placements": f"WITH {_PARTS}, {_LAYOUT} SELECT scan, zi, xi, r_lo, r_hi, c_lo, c_hi, c_lo_mirror, c_hi_mirror FROM fp",
    "mosaic_summary": f"WITH {_PARTS}, {_LAYOUT}, f AS (SELECT *, (2 * CASE WHEN n_x = 1 THEN det_w - inset ELSE (n_x - 1) * (det_w - overlap) - inset + det_w END)::INT AS fov_px FROM ly) SELECT scan, n_x, n_z, fov_px, fov_px >= 2 * r AS covers, (480 * n_x * n_z)::BIGINT AS projections, {_r('fov_px * (1.38::DOUBLE * 8) * 1e-3', 'fov_mm')} FROM f",
    "angle_grid": f"SELECT p_partkey AS scan, t::INT AS t, {_r('t * (180.0::DOUBLE / (p_partkey % 16 + 8))', 'theta_deg')}, {_r('t * (180.0::DOUBLE / (p_partkey % 16 + 8)) + 180.0', 'opposite_deg')} FROM (SELECT p_partkey, unnest(range(p_partkey % 16 + 8)) AS t FROM part)",
    "diag_tiles": f"WITH {_PARTS}, {_LAYOUT} SELECT scan, xi::INT AS xi, round_even((xi * (n_z - 1) / greatest(1, n_x - 1)::DOUBLE)::DOUBLE, 0)::INT AS zi FROM (SELECT *, unnest(range(n_x)) AS xi FROM ly)",
    "bank_plan": "SELECT (floor((o_orderkey % 1000) / 125) + 8 * floor(o_orderkey / 1000))::INT AS bank, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
    "vchunk_iter": "WITH s AS (SELECT p_partkey, p_size AS n0, p_size % 7 + 3 AS n1, p_size % 5 + 2 AS n2 FROM part), c AS (SELECT *, ceil(n0 / 8.0)::INT AS k0, ceil(n1 / 4.0)::INT AS k1, ceil(n2 / 3.0)::INT AS k2 FROM s), a AS (SELECT *, unnest(range(k0)) AS i0 FROM c), b AS (SELECT *, unnest(range(k1)) AS i1 FROM a), e AS (SELECT *, unnest(range(k2)) AS i2 FROM b), f AS (SELECT *, least(8, n0 - i0 * 8)::INT AS s0, least(4, n1 - i1 * 4)::INT AS s1, least(3, n2 - i2 * 3)::INT AS s2 FROM e) SELECT p_partkey, i0::INT AS i0, i1::INT AS i1, i2::INT AS i2, s0, s1, s2, ((i0 * k2 + i2) * k1 + i1)::INT AS position, (s0 * s1 * s2 * 4)::BIGINT AS bytes FROM f",
    "task_split": "WITH r AS (SELECT p_partkey, p_size AS low, p_size * 3 AS high, p_size // 8 AS f, ceil(p_size * 3 / 8.0)::BIGINT - p_size // 8 AS units FROM part), e AS (SELECT *, ceil(units / least(4, units)::DOUBLE)::BIGINT AS each FROM r), k AS (SELECT *, unnest(range(ceil(units / each::DOUBLE)::BIGINT)) AS task FROM e) SELECT p_partkey, task::INT AS task, greatest(low, (f + task * each) * 8)::BIGINT AS task_low, least(high, (f + (task + 1) * each) * 8)::BIGINT AS task_high FROM k",
    "theta_slab": f"WITH {_STACK} SELECT * FROM st WHERE t >= 3 AND t < 7",
    "z_slab": f"WITH {_STACK} SELECT * FROM st WHERE z >= 2 AND z < 5",
    "dataset_info": f"WITH {_STACK} SELECT max(t)::BIGINT + 1 AS n_t, max(z)::BIGINT + 1 AS n_z, max(x)::BIGINT + 1 AS n_x, count(*) AS rows FROM st",
    "center_crop": f"WITH {_VOLUME} SELECT z, y - 3 AS y, x - 2 AS x, v FROM vol WHERE y BETWEEN 3 AND 12 AND x BETWEEN 2 AND 13",
    "center_pad": f"WITH {_VOLUME} SELECT a.range::INT AS z, b.range::INT AS y, c.range::INT AS x, coalesce(v, 0.0) AS v FROM range(8) a, range(20) b, range(18) c LEFT JOIN vol ON vol.z = a.range AND vol.y + 2 = b.range AND vol.x + 1 = c.range",
    "circular_mask": f"WITH {_VOLUME} SELECT z, y, x, {_r('v * ' + _SINE.format('least(1.0, greatest(0.0, (6.0 - sqrt((y - 7.5) * (y - 7.5) + (x - 7.5) * (x - 7.5))) / 3.0 + 0.5))'))} FROM vol",
    "z_taper": f"WITH {_VOLUME}, d AS (SELECT *, least(z - 1, 6 - z) AS d FROM vol) SELECT z, y, x, {_r('v * CASE WHEN d < 0 THEN 0.0 WHEN d >= 2 THEN 1.0 ELSE ' + _SINE.format('(d + 0.5) / 2') + ' END')} FROM d",
    "tile_extract_360": f"WITH {_MOSAIC}, {_SIDES} SELECT scan, zi, xi, t::INT AS t, z::INT AS z, x::INT AS x, v FROM px",
    "fold_180": f"WITH {_STACK} SELECT t % 6 AS t, z, x, v, (t >= 6)::INT AS second FROM st",
    "strided_slice": f"WITH {_VOLUME} SELECT z // 2 AS z, y, x // 3 AS x, v FROM vol WHERE z % 2 = 0 AND x % 3 = 0",
    "symmetric_pad": f"WITH {_STACK}, m AS (SELECT range::INT AS o, CASE WHEN range < 4 THEN 3 - range WHEN range >= 12 THEN 19 - range ELSE range - 4 END AS i FROM range(16)), w AS (SELECT range::INT AS o, CASE WHEN range < 8 THEN 7 - range WHEN range >= 24 THEN 39 - range ELSE range - 8 END AS i FROM range(32)) SELECT t, m.o AS z, w.o AS x, v FROM st JOIN m ON st.z = m.i JOIN w ON st.x = w.i",
    "edge_pad": f"SELECT vec_id, (i - 1)::INT AS x, {_r('embedding[least(64, greatest(1, i - 8))]::DOUBLE')} FROM embeddings, range(1, 81) r(i)",
    "zero_pad": f"SELECT vec_id, (i - 1)::INT AS x, {_r('CASE WHEN i BETWEEN 5 AND 68 THEN embedding[i - 4] ELSE 0 END::DOUBLE')} FROM embeddings, range(1, 73) r(i)",
    "reflect_index": "SELECT event_id, CASE WHEN m < 37 THEN m ELSE 73 - m END::INT AS i FROM (SELECT event_id, ((event_id - 500) % 74 + 74) % 74 AS m FROM events)",
    "upsample_xy": f"WITH {_VOLUME}, {_ZOOM} SELECT z, a.o AS y, b.o AS x, {_r('sum(a.w * b.w * v)')} FROM vol JOIN tap a ON vol.y = a.i JOIN tap b ON vol.x = b.i GROUP BY 1, 2, 3",
    "upsample_z": f"WITH {_VOLUME}, n AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY y, x ORDER BY z), v) AS w FROM vol) SELECT (z * 3 + r.range)::INT AS z, y, x, {_r('(1 - r.range / 3.0::DOUBLE) * v + r.range / 3.0::DOUBLE * w')} FROM n, range(3) r",
    "z_resample": f"WITH {_VOLUME}, o AS (SELECT range::INT AS o, range / 1.5::DOUBLE AS s, floor(range / 1.5::DOUBLE)::INT AS f FROM range(13)) SELECT o AS z, a.y, a.x, {_r('CASE WHEN b.v IS NULL THEN a.v ELSE (1 - (s - f)) * a.v + (s - f) * b.v END')} FROM o JOIN vol a ON a.z = f LEFT JOIN vol b ON b.z = f + 1 AND b.y = a.y AND b.x = a.x",
    "nearest_repeat": f"WITH {_VOLUME} SELECT (z * 2 + a.range)::INT AS z, y, (x * 2 + b.range)::INT AS x, v FROM vol, range(2) a, range(2) b",
    "bin2d": f"WITH {_STACK} SELECT t, z // 3 AS z, x // 3 AS x, {_r('avg(v)')} FROM st WHERE z < 6 AND x < 15 GROUP BY 1, 2, 3",
    "gaussian_smooth": f"WITH {_VOLUME}, {_GAUSS} SELECT z, y, x, {_r('v')} FROM g3",
    "unsharp": f"WITH {_VOLUME}, {_GAUSS} SELECT z, y, x, {_r('vol.v + 0.7 * (vol.v - g3.v)')} FROM vol JOIN g3 USING (z, y, x)",
    "psi_from_proj": f"WITH {_STACK} SELECT t, z, x, {_r('exp(-v / 20.0 / 100.0) * cos(v / 20.0)', 're')}, {_r('exp(-v / 20.0 / 100.0) * sin(v / 20.0)', 'im')} FROM st",
    "intensity": f"WITH {_STACK} SELECT t, z, x, {_r('exp(-v / 20.0 / 100.0 * 2)')} FROM st",
    "fresnel": f"WITH {_STACK}, ps AS (SELECT t, z, x, exp(-v / 20.0 / 100.0) * cos(v / 20.0) AS re, exp(-v / 20.0 / 100.0) * sin(v / 20.0) AS im FROM st), {_kernel('hx', 16)}, {_kernel('hz', 8)}, ax AS MATERIALIZED {_propagated('ps', 'x', 'z', 'hx', 16)}, az AS {_propagated('ax', 'z', 'x', 'hz', 8)} SELECT t, z, x, {_r('re', 're', 5)}, {_r('im', 'im', 5)} FROM az",
    "fresnel_distances": f"WITH {_STACK}, ps AS (SELECT t, z, x, exp(-v / 20.0 / 100.0) * cos(v / 20.0) AS re, exp(-v / 20.0 / 100.0) * sin(v / 20.0) AS im FROM st), "
    + ", ".join(f"{_kernel(f'hx{k}', 16, distance)}, {_kernel(f'hz{k}', 8, distance)}, ax{k} AS MATERIALIZED {_propagated('ps', 'x', 'z', f'hx{k}', 16)}, az{k} AS {_propagated(f'ax{k}', 'z', 'x', f'hz{k}', 8)}" for k, distance in enumerate((0.2, 0.7)))
    + f" SELECT d::INT AS d, t, z, x, {_r('re', 're', 5)}, {_r('im', 'im', 5)} FROM (SELECT 0 AS d, * FROM az0 UNION ALL SELECT 1, * FROM az1)",
    "paganin": f"WITH {_STACK}, q AS (SELECT a.range AS kz, b.range AS kx, 5e-4 / ((1.24e-9 / 30.0) * 0.2 * (pow(CASE WHEN b.range < 8 THEN b.range ELSE b.range - 16 END / (16 * 1.38e-6), 2) + pow(CASE WHEN a.range < 4 THEN a.range ELSE a.range - 8 END / (8 * 1.38e-6), 2)) / (4 * pi()) + 5e-4) AS h FROM range(8) a, range(16) b), k AS MATERIALIZED (SELECT a.range AS dz, b.range AS dx, sum(h * cos(2 * pi() * (kz * a.range / 8.0 + kx * b.range / 16.0))) / 128 AS h FROM range(8) a, range(16) b, q GROUP BY 1, 2), c AS (SELECT o.t, o.z, o.x, sum(h * (0.5 + s.v / 100)) AS v FROM st o JOIN st s ON o.t = s.t JOIN k ON dz = (o.z - s.z + 8) % 8 AND dx = (o.x - s.x + 16) % 16 GROUP BY 1, 2, 3) SELECT t, z, x, {_r('-ln(greatest(v, 1e-6))', 'v', 5)} FROM c",
    "dezinger": f"WITH {_STACK}, m AS (SELECT *, range::INT AS k FROM (SELECT 1), range(9)), nb AS (SELECT c.t, c.z, c.x, median(s.v) AS md FROM st c, m, st s WHERE s.z = c.z AND s.t = CASE WHEN c.t + k // 3 - 1 < 0 THEN 0 WHEN c.t + k // 3 - 1 > 11 THEN 11 ELSE c.t + k // 3 - 1 END AND s.x = CASE WHEN c.x + k % 3 - 1 < 0 THEN 0 WHEN c.x + k % 3 - 1 > 15 THEN 15 ELSE c.x + k % 3 - 1 END GROUP BY 1, 2, 3) SELECT t, z, x, {_r('CASE WHEN v - md > 2.0 THEN md ELSE v END')} FROM st JOIN nb USING (t, z, x)",
    "darkflat": f"WITH {_STACK}, f AS (SELECT z, x, avg(CASE WHEN t >= 6 THEN v + 100 END) AS f, avg(CASE WHEN t < 6 THEN v END) AS d FROM st GROUP BY 1, 2) SELECT t, z, x, {_r('(v - d) / (f * (1 + 1e-5) - d)')} FROM st JOIN f USING (z, x)",
    "tent_weight": f"WITH {_MOSAIC}, {_SIDES} SELECT scan, ot AS t, oz AS z, ox AS x, {_r('sum(least(z + 0.5, hh - 0.5 - z, 4) * least(x + 0.5, ww - 0.5 - x, 4))::DOUBLE', 'w')}, count(*) AS n FROM px GROUP BY 1, 2, 3, 4",
    "stitch": f"WITH {_MOSAIC}, {_SIDES}, c AS (SELECT DISTINCT scan, ot, oz, ox FROM px) SELECT ms.scan, t, z, x, {_r('CASE WHEN c.scan IS NULL THEN 1.0 ELSE v END')} FROM ms LEFT JOIN c ON c.scan = ms.scan AND ot = t AND oz = z AND ox = x",
    "stack_stats": f"WITH {_STACK} SELECT min(v) AS least, max(v) AS most, {_r('avg(v)', 'mean')}, count(v) AS n, coalesce(bool_or(isnan(v)), false) AS has_nan FROM st",
    "axis_mean": f"WITH {_STACK} SELECT z, x, {_r('avg(v)')} FROM st GROUP BY 1, 2",
    "percentile_clip": f"SELECT (l_suppkey % 8)::INT AS z, {_r('quantile_cont(l_extendedprice, 0.01)', 'low', 4)}, {_r('quantile_cont(l_extendedprice, 0.99)', 'high', 4)} FROM lineitem GROUP BY 1",
    "rel_error": f"WITH {_VOLUME} SELECT {_r('max(abs(a.v - b.v)) / max(abs(a.v))', 'rel_max')}, {_r('sqrt(sum((a.v - b.v) * (a.v - b.v))) / sqrt(sum(a.v * a.v))', 'rel_l2')}, {_r('sum(a.v * b.v)', 'inner')} FROM vol a JOIN vol b ON a.z = b.z AND a.y = b.y AND a.x = 15 - b.x",
    "stage_throughput": f"SELECT l_returnflag, l_linestatus, {_r('sum(l_extendedprice) / max(l_quantity)', 'rate', 9)}, {_r('min(l_extendedprice / l_quantity)', 'slowest', 9)}, {_r('max(l_extendedprice / l_quantity)', 'fastest', 9)} FROM lineitem GROUP BY 1, 2",
    "human_bytes": "SELECT o_orderkey, CASE " + " ".join(f"WHEN b >= {1024**k} THEN printf('%.1f {u}', b / {1024.0**k}::DOUBLE)" for k, u in ((5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))) + " ELSE printf('%.1f B', b::DOUBLE) END AS size FROM (SELECT o_orderkey, o_orderkey * o_custkey AS b FROM orders)",
    "nufft_gather": f"WITH {_VOLUME}, {_TAPS} SELECT z, t, r, {_r('sum(w * v) / 8', 're', 2)}, {_r('sum(w * v * 0.5) / 8', 'im', 2)} FROM tp JOIN vol ON vol.y = ky AND vol.x = kx GROUP BY 1, 2, 3",
    "nufft_scatter": f"WITH {_STACK}, {_taps(16, 12)} SELECT z, ky, kx, {_r('sum(w * v)', 're', 2)}, {_r('sum(w * v * 0.5)', 'im', 2)} FROM tn JOIN st ON st.t = tn.t AND st.x = r GROUP BY 1, 2, 3",
    "radon_forward": f"WITH {_VOLUME}, {_taps(16, 12)}, {_forward('vol', 16, 12)} SELECT t, z, x, {_r('v', 'v', 3)} FROM fw",
    "radon_adjoint": f"WITH {_STACK}, {_taps(16, 12)}, {_adjoint('st', 16, 12)} SELECT z, y, x, {_r('v', 'v', 5)} FROM ad",
    "radon_multiplier": f"WITH {_VOLUME} SELECT z, y, x, {_r('v * ' + _multiplier(16, 12), 'v', 9)} FROM vol",
    "fbp_filter": f"WITH st AS (SELECT vec_id AS t, 0 AS z, (unnest(range(64)))::INT AS x, unnest(embedding)::DOUBLE AS v FROM embeddings), {_filter_kernel('shepp', 64)}, {_filtered(64)} SELECT t AS vec_id, x, {_r('v', 'v', 3)} FROM fl",
    "fbp_reconstruction": f"WITH {_STACK}, {_filter_kernel('ramp', 16)}, {_filtered(16)}, {_taps(16, 12)}, {_adjoint('fl', 16, 12)} SELECT z, y, x, {_r('v', 'v', 3)} FROM ad",
    "stripe_removal": f"WITH {_STACK}, {_unstriped('st')} SELECT t, z, x, {_r('v', 'v', 5)} FROM us",
    "corrected_tiles": f"WITH {_STACK}, {_DEZINGER}, {_unstriped('dd')} SELECT t, z, x, {_r('v', 'v', 5)} FROM us",
    "wavelet_bands": f"WITH {_STACK} SELECT t, z, x // 2 AS x, {_r('sum(v) / sqrt(2)')}, {_r('abs(sum(v * (1 - 2 * (x % 2)))) / sqrt(2)', 'd')}, {_r('sum(CASE WHEN x % 2 = 0 THEN v ELSE 0 END)', 'again')} FROM st GROUP BY 1, 2, 3",
    "stitch_uneven": f"WITH {_MOSAIC}, {_SIDES}, m AS (SELECT scan, ot, oz, ox, sum(w * u) / sum(w) AS v FROM (SELECT *, v + 100 * zi + 10 * xi + CASE WHEN t >= 4 THEN 5 ELSE 0 END AS u, least(z + 0.5, hh - 0.5 - z, 4) * least(x + 0.5, ww - 0.5 - x, 4) AS w FROM px) GROUP BY 1, 2, 3, 4) SELECT ms.scan, t, z, x, {_r('coalesce(m.v, 1.0)')} FROM ms LEFT JOIN m ON m.scan = ms.scan AND ot = t AND oz = z AND ox = x",
    "tile_files": f"WITH {_MOSAIC}, {_SIDES} SELECT scan, zi, xi, count(*) AS n, {_r('sum(v)', 'total')} FROM px WHERE zi <= xi GROUP BY 1, 2, 3",
    "store_box": f"WITH {_STACK} SELECT * FROM st WHERE z >= 3 AND z < 7 AND x >= 4 AND x < 9",
    "store_range": f"WITH {_STACK} SELECT * FROM st WHERE t >= 5 AND t < 10",
    "store_boxes": f"WITH el AS (SELECT vec_id AS t, label AS z, (unnest(range(len(embedding))))::INT AS x, unnest(embedding)::DOUBLE AS v FROM embeddings), pa AS (SELECT unnest(['whole', 't', 'z', 'x', 'box']) AS part) SELECT part, z, x, count(*) AS n, {_r('sum(v)', 'total', 3)} FROM el, pa WHERE part = 'whole' OR ((part NOT IN ('t', 'box') OR t >= 200) AND (part NOT IN ('z', 'box') OR z >= 3 AND z < 7) AND (part NOT IN ('x', 'box') OR x >= 16 AND x < 40)) GROUP BY 1, 2, 3",
    "bank_files": f"WITH {_STACK} SELECT (floor((t % 5) / 3) + 2 * floor(t / 5))::INT AS bank, min(t) AS first, max(t) AS last, count(*) AS n, sum(v) AS total FROM st GROUP BY 1",
    "tiff_pages": f"SELECT g.z, g.y, g.x, {_r('coalesce(s.v, 0.0)::FLOAT::DOUBLE', 'v', 3)} FROM (SELECT a.range::INT AS z, b.range::INT AS y, c.range::INT AS x FROM range((SELECT max(s_suppkey) + 1 FROM supplier)) a, range(4, 12) b, range(16) c WHERE a.range >= 1) g LEFT JOIN (SELECT l_suppkey AS z, l_partkey % 16 AS y, l_orderkey % 16 AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) s USING (z, y, x)",
    "catalog_text": f"WITH {_PARTS}, {_LAYOUT} SELECT DISTINCT zi, xi, z_center, x_center, crop_top, crop_bottom, crop_left, crop_right, 4 AS half, 4 AS overlap FROM pl",
    "tile_index": "SELECT p_size AS zi, p_partkey::INT AS xi FROM part WHERE p_partkey % 3 <> 0",
    "rectangle": f"WITH {_VOLUME} SELECT z, y - 3 AS y, x - 2 AS x, v FROM vol WHERE y >= 3 AND y < 11 AND x >= 2 AND x < 15",
    "sharp_mask": f"WITH {_VOLUME} SELECT z, y, x, v * CASE WHEN sqrt((y - 7.5) * (y - 7.5) + (x - 7.5) * (x - 7.5)) <= 6.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM vol",
    "zoom_xy": f"WITH {_VOLUME}, {_zoom('za', 16, 21)}, {_zoom('zb', 16, 23)} SELECT z, a.o AS y, b.o AS x, {_r('sum(a.w * b.w * v)')} FROM vol JOIN za a ON vol.y = a.i JOIN zb b ON vol.x = b.i GROUP BY 1, 2, 3",
    "millimetres": f"SELECT p_partkey, {_r('p_retailprice * (1.38::DOUBLE * 8 / p_size) * 1e-3', 'mm', 9)}, {_r('p_retailprice', 'px')}, {_r('p_retailprice / ((1.38::DOUBLE * 8 / p_size) * 1e-3)', 'of_mm', 3)} FROM part",
    "standard_geometry": "SELECT DISTINCT p_size AS ups, (2426 * p_size // 8)::INT AS det_h, (3232 * p_size // 8)::INT AS det_w, (200 * p_size // 8)::INT AS overlap, (3072 * p_size)::INT AS nz, (100 * p_size // 2)::INT AS z_pad, p_size * 2918 / 2.0::DOUBLE AS sample_r, (p_size * 2972)::DOUBLE AS sample_h FROM part",
    "cone_geometry": f"SELECT p_partkey, {_r('(50000.0::DOUBLE + p_size * 100.0::DOUBLE) / 50000.0::DOUBLE', 'magnification', 9)}, {_r('p_size / 10.0::DOUBLE * (50000.0::DOUBLE + p_size * 100.0::DOUBLE) / (50000.0::DOUBLE + (p_partkey % 31 - 15))', 'x_det', 9)}, {_r('4.46::DOUBLE / 2 / 50000.0::DOUBLE * p_size', 'spread', 9)} FROM part",
    "fresnel_numbers": "SELECT p_partkey, round((1.38e-6 * 1.38e-6) / ((1.24e-9 / 30.0) * 1.0) / (p_size / 100.0::DOUBLE), 6) AS number FROM part",
    "strip_order": f"WITH {_TAPS}, b AS (SELECT t, r, (CASE WHEN k > 8 THEN 16 - k ELSE k END // 3)::INT AS bin FROM (SELECT t, r, ((round_even(16 * x0, 0)::INT % 16) + 16) % 16 AS k FROM pt)) SELECT bin, (row_number() OVER (PARTITION BY bin ORDER BY t, r) - 1)::INT AS place, t, r FROM b",
    "theta_prefix": f"WITH {_STACK} SELECT t, z, x, v, {_r('t * (180.0::DOUBLE / 12)', 'theta_deg')} FROM st WHERE t < 6",
    "line_callback": f"WITH {_STACK} SELECT t, z, x, {_r('sum(v) OVER (PARTITION BY t, z ORDER BY x)', 'total')}, {_r('v - coalesce(lag(v) OVER (PARTITION BY t, z ORDER BY x), 0)', 'step')} FROM st",
    "plane_callback": f"WITH {_STACK} SELECT z, x, {_r('sum(v)')} FROM st GROUP BY 1, 2",
    "cast_single": f"SELECT (l_suppkey % 8)::INT AS z, {_r('sum(l_extendedprice::FLOAT::DOUBLE)', 'total', 3)}, max(l_tax::FLOAT::DOUBLE) AS most FROM lineitem GROUP BY 1",
    "block_plan": "WITH s AS (SELECT p_size, count(*) AS count FROM part GROUP BY 1) SELECT p_size, (SELECT max(k.range)::INT FROM range(1, 601) k WHERE (p_size * 12) % k.range = 0 AND k.range <= greatest(1, 200000 // (p_size * 1000))) AS lines, count FROM s",
    "kx_bins": f"WITH {_TAPS}, b AS (SELECT (CASE WHEN k > 8 THEN 16 - k ELSE k END // 3)::INT AS bin FROM (SELECT ((round_even(16 * x0, 0)::INT % 16) + 16) % 16 AS k FROM pt)), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1) SELECT bin, n, (sum(n) OVER (ORDER BY bin) - n)::BIGINT AS first FROM c",
    "ky_bands": f"WITH {_TAPS} SELECT band, count(*) AS n FROM (SELECT DISTINCT t, r, (ky // 4)::INT AS band FROM tp) GROUP BY 1",
}
ORACLE_SQL |= {"stripes_by_strips": ORACLE_SQL["stripe_removal"], "radon_by_lines": ORACLE_SQL["radon_forward"], "radon_adjoint_by_lines": ORACLE_SQL["radon_adjoint"], "fbp_by_lines": ORACLE_SQL["fbp_reconstruction"], "paganin_by_lines": ORACLE_SQL["paganin"]}

QUERIES = {
    f.__name__: f
    for f in (
        tile_layout, mirror_placements, mosaic_summary, angle_grid, diag_tiles, bank_plan, vchunk_iter, task_split, theta_slab, z_slab, dataset_info, center_crop, center_pad, circular_mask, z_taper, tile_extract_360,
        fold_180, strided_slice, symmetric_pad, edge_pad, zero_pad, reflect_index, upsample_xy, upsample_z, z_resample, nearest_repeat, bin2d, gaussian_smooth, unsharp, psi_from_proj, intensity, fresnel, paganin,
        dezinger, darkflat, tent_weight, stitch, stack_stats, axis_mean, percentile_clip, rel_error, stage_throughput, human_bytes, nufft_gather, nufft_scatter, kx_bins, ky_bands, radon_forward, radon_adjoint,
        fbp_filter, fbp_reconstruction, stripe_removal, whole_scan, radon_by_lines, radon_adjoint_by_lines, paganin_by_lines, fbp_by_lines, fresnel_distances, stripes_by_strips, radon_multiplier, stitch_uneven, tile_files, store_box, store_range, store_boxes, bank_files,
        catalog_text, tile_index, rectangle, sharp_mask, zoom_xy, millimetres, standard_geometry, cone_geometry, fresnel_numbers, strip_order, theta_prefix, line_callback, plane_callback, cast_single, wavelet_bands,
        block_plan, corrected_tiles, tiff_pages,
    )
}
