"""The imaging operators against closed forms, identities and the shipped layout of a mosaic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import blocks, fbp, geometry, lines, model, mosaic, radon, resample, reshape, stats, stencil, stripe, wave
from lamina.plans.scan import Scan, corrected, enlarged, measured, prepared, restored, statistics, steps, tiled, whole
from lamina.registry import QUERIES
from lamina.sources import arrays, store


def table(spark, array, *axes):
    at = np.indices(array.shape).reshape(len(axes), -1)
    rows = [(*map(int, k), float(v)) for k, v in zip(at.T, array.ravel())]
    return spark.createDataFrame(rows, ", ".join(f"{a} int" for a in axes) + ", v double")


def array(df, *axes, value="v"):
    rows = df.toPandas().sort_values(list(axes))
    return rows[value].to_numpy().reshape([int(rows[a].max()) + 1 for a in axes])


def test_standard_layouts(spark):
    scans = geometry.standard_scans(spark.createDataFrame([(1,), (2,), (8,), (128,)], "ups int"))
    tiles = geometry.placements(scans)
    assert {(r.ups, r["count"]) for r in tiles.groupBy("ups").count().collect()} == {(u, 44) for u in (1, 2, 8, 128)}
    first = tiles.where("ups = 1").orderBy("zi", "xi").select("z_center", "x_center", "crop_top", "crop_bottom", "crop_left", "crop_right").collect()
    assert [tuple(r) for r in first[:5]] == [(145, 1713, 6, 0, 0, 0), (145, 2092, 6, 0, 0, 0), (145, 2471, 6, 0, 0, 0), (145, 2850, 6, 0, 0, 0), (423, 1713, 0, 0, 0, 0)]
    assert first[40].crop_bottom == 5


def test_catalog_round_trip(spark, tmp_path):
    tiles = geometry.placements(geometry.standard_scans(spark.createDataFrame([(1,)], "ups int")))
    header = dict(NZ=3072, N=3072, DET_H=303, DET_W=404, n_z=11, n_x=4, NTHETA=4608, N_HALF=2304, OVERLAP=25)
    store.catalog_lines(tiles, header).write.text(str(tmp_path / "catalog"))
    read, rows = store.read_catalog(spark.read.text(str(tmp_path / "catalog")))
    assert read == header
    assert sorted(rows.select(*store.CATALOG_COLUMNS).collect()) == sorted(tiles.select(*store.CATALOG_COLUMNS).collect())
    with pytest.raises(ValueError, match="OVERLAP"):
        store.catalog_lines(tiles, {k: v for k, v in header.items() if k != "OVERLAP"})
    with pytest.raises(ValueError, match="NTHETA"):
        store.read_catalog(spark.createDataFrame([("# NZ=1",)], "value string"))


def test_store_prunes_bands(spark, tmp_path):
    values = model.grid(spark, t=20, z=4, x=4).withColumn("v", F.rand(1))
    store.write(values, str(tmp_path / "s"), "proj", band=4)
    part = store.read(spark, str(tmp_path / "s"), "t", 5, 7, band=4)
    assert sorted({r.t for r in part.select("t").collect()}) == [5, 6] and part.count() == 32
    assert len(part.inputFiles()) == len(spark.read.parquet(str(tmp_path / "s")).inputFiles())  # files are skipped when it runs
    assert "PartitionFilters: [isnotnull(band" in store.described(part)
    with pytest.raises(ValueError):
        store.write(values, str(tmp_path / "s"), "rows")


def test_foreign_files_say_what_they_need(spark):
    with pytest.raises(ImportError, match="tifffile"):
        arrays.pages(spark, "x.tif", 1, "tiff")


def test_tile_names(spark):
    files = spark.createDataFrame([("/a/3_12.h5",), ("/a/x_1.h5",), ("/a/0_2.h5",), ("b",)], "path string")
    assert [(r.zi, r.xi) for r in store.tile_names(files).collect()] == [(0, 2), (3, 12)]


def test_tiles_stitch_to_what_was_cut(spark):
    scans = spark.createDataFrame([(0, 12, 16, 4, 4, 4, 18.0, 18.0, 40, 24, 3)], "scan int, det_h int, det_w int, overlap int, inset int, z_overlap int, sample_r double, sample_h double, n int, nz int, z_pad int")
    sizes = {"scan": 1, "t": 3, "z": 24, "x": 40}
    whole = model.grid(spark, **sizes).withColumn("v", F.rand(3))
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    tiles = geometry.footprints(geometry.placements(scans))
    again = mosaic.uncovered_filled(mosaic.stitched(mosaic.cut(whole, tiles, 3), tiles, 3), sizes)
    both = whole.join(again.withColumnRenamed("v", "w"), list(sizes)).toPandas()
    covered = both.w != 1.0
    assert covered.sum() > 0.5 * len(both) and np.allclose(both.v[covered], both.w[covered], atol=1e-12) and (~covered).any()


def test_projection_of_a_blob():
    n, angles, (cx, cy), s = 64, 48, (40, 27), 5.0
    y, x = np.mgrid[:n, :n]
    t = radon.transform(n, angles)
    found = t.forward(np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s)))
    j = np.arange(n) - n // 2
    at = (cx - n // 2) * np.cos(t.theta) - (cy - n // 2) * np.sin(t.theta)
    want = math.sqrt(2 * math.pi) * s * np.exp(-((j - at[:, None]) ** 2) / (2 * s * s)) / math.sqrt(n * angles)
    assert abs(found - want).max() < 1e-4 * want.max()
    with pytest.raises(ValueError):
        radon.Transform(33, t.theta)


def test_adjoint_identity(spark):
    draw = np.random.default_rng(0)
    a, b = draw.standard_normal((2, 16, 16)), draw.standard_normal((12, 2, 16))
    forward = array(radon.projected(table(spark, a, "z", "y", "x"), 12), "t", "z", "x")
    back = array(radon.back_projected(table(spark, b, "t", "z", "x")), "z", "y", "x")
    assert (forward * b).sum() == pytest.approx((a * back).sum(), rel=1e-9)


def test_taps_are_the_transforms(spark):
    n, angles = 8, 6
    image = np.random.default_rng(1).standard_normal((n, n))
    t = radon.Transform(n, np.arange(angles) * math.pi / angles)
    wide = np.zeros((2 * n, 2 * n))
    wide[n // 2 : n // 2 + n, n // 2 : n // 2 + n] = image * t.phi
    spectrum = np.fft.fft2(wide)
    rows = [(0, ky, kx, float(spectrum[ky, kx].real), float(spectrum[ky, kx].imag)) for ky in range(2 * n) for kx in range(2 * n)]
    points = radon.samples(spark.createDataFrame([(k, k * math.pi / angles) for k in range(angles)], "t int, theta double"), n)
    got = radon.gathered(spark.createDataFrame(rows, "z int, ky int, kx int, re double, im double"), points, n)
    lines = array(got, "t", "r", value="re") + 1j * array(got, "t", "r", value="im")
    found = np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(lines, axes=1), axis=1), axes=1).real / 4
    assert np.allclose(found, t.forward(image), atol=1e-9)


def test_filters():
    n = 64
    w = fbp.weights("ramp", n)
    t = np.arange(len(w)) / (4 * n)
    assert np.allclose(w[19:80] / (3 * n * t[19:80]), 1, atol=1e-3) and 1.05 < w[1] / (3 * n * t[1]) < 1.07
    for name in fbp.FILTERS:
        assert np.isfinite(fbp.weights(name, 16)).all()
    with pytest.raises(ValueError, match="unknown"):
        fbp.weights("sinc", n)


def test_reconstruction_gain(spark):
    n, angles, s = 32, 24, 3.0
    y, x = np.mgrid[:n, :n]
    blob = np.exp(-((x - 16) ** 2 + (y - 14) ** 2) / (2 * s * s))[None]
    again = array(fbp.reconstructed(radon.projected(table(spark, blob, "z", "y", "x"), angles)), "z", "y", "x")
    gain = 3 * n * angles / (math.pi * n * angles)
    assert again[0, 14, 16] == pytest.approx(gain * blob[0, 14, 16], rel=0.1)


def test_propagation(spark):
    draw = np.random.default_rng(2)
    re, im = draw.standard_normal((2, 1, 8, 16))
    waves = table(spark, re, "t", "z", "x").withColumnRenamed("v", "re").join(table(spark, im, "t", "z", "x").withColumnRenamed("v", "im"), ["t", "z", "x"])
    still = wave.propagated(waves, 0.0)
    assert np.allclose(array(still, "t", "z", "x", value="re"), re) and np.allclose(array(still, "t", "z", "x", value="im"), im)
    far = wave.propagated(waves, 0.3, voxel=1e-6)
    psi = np.pad((re + 1j * im)[0], ((4, 4), (8, 8)), mode="symmetric")
    fz, fx = np.meshgrid(np.fft.fftfreq(16, 1e-6), np.fft.fftfreq(32, 1e-6), indexing="ij")
    want = np.fft.ifft2(np.fft.fft2(psi) * np.exp(-1j * np.pi * wave.wavelength(30) * 0.3 * (fx**2 + fz**2)))[4:12, 8:24]
    assert np.allclose(array(far, "t", "z", "x", value="re")[0], want.real) and np.allclose(array(far, "t", "z", "x", value="im")[0], want.imag)


def test_phase_of_a_constant(spark):
    flat = table(spark, np.full((1, 8, 8), 0.7), "t", "z", "x")
    assert np.allclose(array(wave.retrieved(flat, 0.2), "t", "z", "x"), -math.log(0.7))


@pytest.mark.parametrize("name", ["haar", "db2", "db4", "sym8", "sym16"])
def test_wavelets_reconstruct(name):
    v = np.random.default_rng(3).standard_normal((37, 50))
    la, ha, ls, hs = stripe.filters(name)
    assert np.allclose(stripe.synthesised(*stripe.analysed(v, la, ha, 1), ls, hs, 1)[:, :50], v, atol=1e-9)


def test_db2_is_known():
    r = math.sqrt(3)
    assert np.allclose(stripe.scaling("db2"), np.array([1 + r, 3 + r, 3 - r, 1 - r]) / (4 * math.sqrt(2)))


def test_stripes_go(spark):
    sino = np.sin(np.arange(40) / 9)[:, None, None] + np.where(np.arange(48) == 20, 5.0, 0.0)[None, None]
    out = array(stripe.stripes_removed(table(spark, sino, "t", "z", "x"), 2.0, "db4", 3), "t", "z", "x")
    assert abs(out[10:30, 0, 20]).mean() < 0.4 * abs(sino[10:30, 0, 20]).mean()


def test_outliers_and_fields(spark):
    v = np.ones((5, 2, 7))
    v[2, 1, 3], v[4, 0, 0] = 50.0, -50.0
    out = array(stencil.dezingered(table(spark, v, "t", "z", "x"), 3, 10.0, {"t": 5, "x": 7}), "t", "z", "x")
    assert out[2, 1, 3] == 1 and out[4, 0, 0] == -50  # bright ones only
    flat = table(spark, np.full((2, 7), 3.0), "z", "x")
    dark = table(spark, np.full((2, 7), 1.0), "z", "x")
    corrected = array(stencil.flat_corrected(table(spark, v, "t", "z", "x"), flat, dark), "t", "z", "x")
    assert corrected[0, 0, 1] == pytest.approx(0) and corrected[2, 1, 3] == pytest.approx(49 / (3 * (1 + 1e-5) - 1))


def test_resampling_ramps(spark):
    ramp = np.arange(4.0)[:, None, None] * 100 + np.arange(6.0)[None, :, None] * 10 + np.arange(6.0)
    v = table(spark, ramp, "z", "y", "x")
    out = array(enlarged(v, 6, 2), "z", "y", "x")
    assert out.shape == (8, 12, 12) and np.allclose(out[0, 0], np.arange(12) * 5 / 11) and np.allclose(out[:, 0, 0], [0, 50, 100, 150, 200, 250, 300, 300])
    assert np.allclose(array(resample.zoomed_axis(v, "x", 6, 6), "z", "y", "x"), ramp)
    assert array(resample.scaled_z(v, 4, 0.5, 2), "z", "y", "x")[1, 0, 0] == 200


def test_pads_and_flips(spark):
    v = np.arange(8.0)[None, :, None] * np.ones((1, 8, 4))
    out = array(reshape.mirror_padded(table(spark, v, "t", "z", "x"), z=8, x=4), "t", "z", "x")
    assert np.array_equal(out[0], np.pad(v[0], ((4, 4), (2, 2)), mode="symmetric"))
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "row array<double>")
    for mode, want in (("edge", [1, 1, 1, 2, 3, 3, 3]), ("zero", [0, 0, 1, 2, 3, 0, 0]), ("mirror", [2, 1, 1, 2, 3, 3, 2])):
        assert row.select(reshape.padded_rows(F.col("row"), 2, 2, mode)).first()[0] == want
    assert array(reshape.flipped(reshape.flipped(table(spark, v, "t", "z", "x"), "z", 8), "z", 8), "t", "z", "x").tolist() == v.tolist()


def test_statistics_of_odd_values(spark):
    v = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    r = stats.described(v).first()
    assert (r.least, r.most, r.n, r.has_nan) == (1.0, 3.0, 3, True)
    r = stats.described(v.where("false")).first()
    assert (r.mean, r.n, r.has_nan) == (0.0, 0, False)


def test_partitioning_changes_nothing(spark):
    v = table(spark, np.random.default_rng(4).standard_normal((12, 3, 16)), "t", "z", "x")
    one, many = (array(fbp.reconstructed(v.repartition(k)), "z", "y", "x") for k in (1, 7))
    assert np.allclose(one, many, rtol=0, atol=1e-12)


def test_whole_scan(spark):
    n, s = 32, 5.0
    y, x = np.mgrid[:n, :n]
    blob = 0.02 * np.exp(-((x - 16) ** 2 + (y - 15) ** 2) / (2 * s * s))[None] * np.ones((4, 1, 1))
    scan = Scan(n=n, nz=4, angles=24, distance=1e-4)
    again = array(restored(measured(table(spark, blob, "z", "y", "x"), scan), scan), "z", "y", "x")
    assert np.unravel_index(again[2].argmax(), again[2].shape) == (15, 16)
    assert np.corrcoef(again[2].ravel(), blob[2].ravel())[0, 1] > 0.95
    with pytest.raises(ValueError):
        Scan(n=33, nz=4, angles=24)
    with pytest.raises(ValueError):
        Scan(n=32, nz=4, angles=24, filter="none at all")


def test_whole_scans_through_the_mosaic(spark):
    n, s = 32, 5.0
    y, x = np.mgrid[:n, :n]
    centres = [(15, 16), (12, 19), (18, 13)]
    blobs = np.array([0.02 * np.exp(-((x - b) ** 2 + (y - a) ** 2) / (2 * s * s))[None] * np.ones((4, 1, 1)) for a, b in centres])
    # Two columns and two rows of tiles, without a crop: 2 w - overlap - inset = n / 2, 2 h - z_overlap = nz.
    scans = spark.createDataFrame([(k, 3, 10, 2, 2, 2, 16.0, 4.0, n, 4, 0) for k in range(3)], "scan int, det_h int, det_w int, overlap int, inset int, z_overlap int, sample_r double, sample_h double, n int, nz int, z_pad int")
    scan = Scan(n=n, nz=4, angles=24, distance=1e-4, level=0)
    again = array(whole(table(spark, blobs, "scan", "z", "y", "x"), scans, scan), "scan", "z", "y", "x")
    assert again.shape == blobs.shape
    for k, at in enumerate(centres):
        assert np.unravel_index(again[k, 2].argmax(), again[k, 2].shape) == at
        # Without a gap and without stripes to remove, tiles change nothing.
        alone = array(restored(measured(table(spark, blobs[k], "z", "y", "x"), scan), scan), "z", "y", "x")
        assert np.allclose(again[k], alone, rtol=0, atol=1e-9)
    tiles, catalog = tiled(apart_measured(spark, blobs, scan), scans, scan)
    assert catalog.count() == 12 and tiles.groupBy("scan", "zi", "xi", "z").count().count() == 3 * 4 * 3
    one = Scan(n=n, nz=4, angles=24, distance=1e-4, wavelet="haar", level=2)
    changed = array(whole(table(spark, blobs[:1], "scan", "z", "y", "x"), scans.where("scan = 0"), one), "scan", "z", "y", "x")
    assert np.isfinite(changed).all() and not np.allclose(changed[0], again[0], rtol=0, atol=1e-6)


def apart_measured(spark, blobs, scan):
    stacks = [measured(table(spark, b, "z", "y", "x"), scan).withColumn("scan", F.lit(k)) for k, b in enumerate(blobs)]
    return stacks[0].union(stacks[1]).union(stacks[2])


def test_whole_scan_grows_with_its_tables(spark):
    rows = {sf: QUERIES["whole_scan"](spark, f"/root/testdata/{sf}").groupBy("scan").count().collect() for sf in ("sf0.001", "sf0.01")}
    for sf, found in rows.items():
        suppliers = spark.read.parquet(f"/root/testdata/{sf}/supplier.parquet").selectExpr("floor(s_suppkey / 8)").distinct().count()
        assert len(found) == suppliers and {r["count"] for r in found} == {8 * 16 * 16}
    assert len(rows["sf0.01"]) > len(rows["sf0.001"])


@pytest.mark.parametrize("budget, single", [(blocks.BUDGET, False), (40_000, False), (10_000, True)])
def test_strips_give_what_planes_give(spark, budget, single):
    """Slices and projections that no task holds: the same numbers by strips, whatever their height, in single precision too."""
    draw = np.random.default_rng(4)
    n, angles = 20, 9
    a, b, i = draw.standard_normal((2, n, n)), draw.standard_normal((angles, 2, n)), 0.5 + 0.5 * draw.random((2, 7, 10))
    volume, stack, seen = table(spark, a, "z", "y", "x"), table(spark, b, "t", "z", "x"), table(spark, i, "t", "z", "x")
    near = lambda x, y: np.allclose(x, y, atol=2e-5 if single else 1e-10)
    forward, adjoint = array(blocks.projected(volume, n, angles, budget, single), "t", "z", "x"), array(blocks.back_projected(stack, n, angles, budget, single), "z", "y", "x")
    assert near(forward, array(radon.projected(volume, angles), "t", "z", "x"))
    assert near(adjoint, array(radon.back_projected(stack), "z", "y", "x"))
    assert (forward * b).sum() == pytest.approx((adjoint * a).sum(), rel=1e-4 if single else 1e-9)
    assert near(array(blocks.reconstructed(stack, n, angles, "shepp", budget, single), "z", "y", "x"), array(fbp.reconstructed(stack, "shepp"), "z", "y", "x"))
    assert near(array(blocks.retrieved(seen, 7, 10, 1.0, 1e-3, budget=budget, single=single), "t", "z", "x"), array(wave.retrieved(seen, 1.0, 1e-3), "t", "z", "x"))
    waves = wave.transmitted(seen, 20.0)
    several = blocks.propagated(waves, 7, 10, (0.0, 0.7), budget=budget, single=single)
    assert near(array(several.where("d = 0"), "t", "z", "x", value="re"), array(waves, "t", "z", "x", value="re"))
    assert near(array(several.where("d = 1"), "t", "z", "x", value="im"), array(wave.propagated(waves, 0.7), "t", "z", "x", value="im"))


def test_strips_shuffle_blocks_not_taps(spark):
    """A few rows for each pair of strips go through the shuffles, of about the elements' bytes, and no tap is a row."""
    n, angles = 64, 12
    image = blocks.from_long(table(spark, np.ones((1, n, n)), "z", "y", "x"), ("z",), ("y", "x"), n, n, 16, single=True)
    budget = 200_000
    out = blocks.projected_strips(image, angles, budget)
    plan = out.rows._sc._jvm.PythonSQLUtils.explainString(out.rows._jdf.queryExecution(), "simple")
    assert "Generate" not in plan and plan.count("Exchange") == 3
    some = blocks.samples(n, angles, blocks.height_for(n + 1, 2 * n, budget, radon.taps(n)[1]))
    assert some.count > 2 and sum(len(some.of(k)) for k in range(some.count)) == n * angles
    beyond = sum(len(some.columns(k)) for k in range(some.count)) - (n + 1)
    assert beyond == 2 * some.reach * some.count


def test_wavelets_are_orthogonal():
    for name, moments in (("haar", 1), ("db4", 4), ("sym16", 16)):
        low = stripe.scaling(name)
        assert low.sum() == pytest.approx(math.sqrt(2)) and len(low) == 2 * moments
        for k in range(len(low) // 2):
            assert (low[2 * k :] * low[: len(low) - 2 * k]).sum() == pytest.approx(float(k == 0), abs=1e-9)
        at = np.arange(len(low)) / len(low)
        assert all(abs((low * (-1.0) ** np.arange(len(low)) * at**p).sum()) < 1e-8 for p in range(moments))
    # The published values of db4 and sym16.
    assert stripe.scaling("db4")[:3] == pytest.approx([0.23037781330885523, 0.7148465705525415, 0.6308807679295904])
    assert stripe.scaling("sym16")[-3:][::-1] == pytest.approx([6.230006701220761e-06, -3.113556407621969e-06, -0.00010943147929529757])
    with pytest.raises(ValueError, match="unknown wavelet"):
        stripe.scaling("coif3")


def test_stripes_at_the_defaults(spark):
    """A stripe goes, and what varies with the angle stays, with sym16 at level 7."""
    draw = np.random.default_rng(6)
    smooth = np.sin(np.arange(96) / 15)[:, None] * np.cos(np.arange(64) / 9)[None, :]
    stripe_ = np.zeros(64)
    stripe_[[20, 41]] = 3.0
    out = stripe.without_stripes(smooth + stripe_[None, :])
    assert abs(out - out.mean() - smooth + smooth.mean())[10:86, [20, 41]].mean() < 1.0
    assert np.corrcoef(out.ravel(), smooth.ravel())[0, 1] > 0.9 and np.isfinite(stripe.without_stripes(draw.random((13, 9)), level=2)).all()


def test_a_missing_tile_is_an_error(spark, tmp_path):
    scans = spark.createDataFrame([(0, 12, 16, 4, 4, 4, 18.0, 18.0, 40, 24, 3)], "scan int, det_h int, det_w int, overlap int, inset int, z_overlap int, sample_r double, sample_h double, n int, nz int, z_pad int")
    tiles = geometry.footprints(geometry.placements(scans))
    pixels = mosaic.cut(model.grid(spark, scan=1, t=2, z=24, x=40).withColumn("v", F.lit(1.0)), tiles, 2)
    store.write_tiles(pixels.where("not (zi = 1 and xi = 0)"), str(tmp_path / "tiles"))
    with pytest.raises(ValueError, match=r"\(0, 1, 0\)"):
        store.read_tiles(spark, str(tmp_path / "tiles"), tiles)
    assert store.read_tiles(spark, str(tmp_path / "tiles"), tiles.where("zi = 0")).count() == pixels.where("zi = 0").count()


def test_banks_are_made_once(spark, tmp_path):
    values = model.grid(spark, t=10, z=2, x=2).withColumn("v", F.lit(1.0))
    store.write_banks(values, str(tmp_path / "b"), "proj", 4, 3)
    read = spark.read.parquet(str(tmp_path / "b"))
    assert sorted((r.bank, r["count"]) for r in read.groupBy("bank").count().collect()) == [(0, 8), (1, 8), (3, 8), (4, 8), (6, 8)]
    with pytest.raises(ValueError, match="exists"):
        store.write_banks(values, str(tmp_path / "b"), "proj", 4, 3)
    with pytest.raises(ValueError, match="layout"):
        store.write_banks(values, str(tmp_path / "c"), "rows")


def test_block_sizes():
    assert lines.block_size(96, 1000, 10_000) == 8 and lines.block_size(97, 1000, 10_000) == 1 and lines.block_size(12, 10, 10**9) == 12


@pytest.mark.parametrize("wavelet, level, budget", [("sym16", 7, 60_000), ("haar", 3, 3_000), ("db4", 2, blocks.BUDGET)])
def test_stripes_by_strips(spark, wavelet, level, budget):
    """The same as in one task, for several levels by strips, of odd sizes, for two tiles at once."""
    draw = np.random.default_rng(9)
    a = draw.random((2, 37, 41))
    stack = table(spark, a, "z", "t", "x")
    found = array(stripe.stripes_removed_by_strips(stack, 37, 41, 1.5, wavelet, level, budget=budget), "z", "t", "x")
    for k in range(2):
        assert np.allclose(found[k], stripe.without_stripes(a[k], 1.5, wavelet, level), atol=1e-9)


def test_percentiles_are_exact_and_spread(spark):
    """Against numpy: ties, one value, a wide spread of magnitudes, infinities, nulls, NaN, a null key, and a key without values."""
    draw = np.random.default_rng(1)
    groups = {"ties": [1.0] * 50 + [2.0] * 3, "one": [5.0], "two": [1.0, 2.0], "wide": (10.0 ** draw.uniform(-300, 300, 300)).tolist(), "far": [-1.7e308, 1.7e308, 0.0, 1.0], "normal": draw.standard_normal(5000).tolist(), None: [3.0, 4.0, 9.0], "ends": [-math.inf, 1.0, 2.0, 3.0, math.inf]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("two", math.nan), ("none", None)]
    found = {r.k: r for r in stats.clip_range(spark.createDataFrame(rows, "k string, v double"), 0.25, 0.9, "k").collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        for p, v in ((0.25, found[k].low), (0.9, found[k].high)):
            s, at = sorted(vs), p * (len(vs) - 1)
            a, b = s[math.floor(at)], s[math.ceil(at)]
            exact = a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b if at % 1 else a
            assert v == pytest.approx(exact, rel=1e-12), (k, p)
    whole = stats.clip_range(spark.createDataFrame(rows, "k string, v double").where("k = 'normal'")).collect()
    assert [*whole[0]] == pytest.approx(np.percentile(groups["normal"], [1, 99]).tolist())
    plan = stats.clip_range(spark.createDataFrame(rows, "k string, v double"), 0.25, 0.9, "k")
    assert "percentile" not in plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")


def test_a_scan_obeys_its_budget(spark):
    """Both sides of the budget: planes in tasks, or strips; the plans differ, the results don't."""
    draw = np.random.default_rng(8)
    n, angles, nz = 12, 6, 4
    volume = table(spark, draw.random((nz, n, n)), "z", "y", "x")
    found = {}
    for budget in (blocks.BUDGET, 4_000):
        scan = Scan(n=n, nz=nz, angles=angles, budget=budget)
        seen = measured(volume, scan)
        back = restored(seen, scan)
        plan = back._sc._jvm.PythonSQLUtils.explainString(back._jdf.queryExecution(), "simple")
        assert ("FlatMapGroupsInPandas" in plan) == (budget == blocks.BUDGET) and ("FlatMapGroupsInArrow" in plan) == (budget != blocks.BUDGET)
        found[budget] = array(back, "z", "y", "x")
    assert np.allclose(found[blocks.BUDGET], found[4_000], atol=1e-9)
    assert blocks.fits_plane(1000, 600) and not blocks.fits_plane(98_304, 98_304)


def test_each_tile_has_its_own_fields(spark):
    """Two tiles under fields of different levels are both flat again, outliers in a field don't count, and attributes stay."""
    draw = np.random.default_rng(2)
    truth = 0.5 + draw.random((2, 8, 2, 6))  # tile, t, z, x
    gain, offset = 100 + draw.random((2, 1, 2, 6)) * np.array([1, 50])[:, None, None, None], np.array([3.0, 20.0])[:, None, None, None]
    shape = lambda a: table(spark, a, "xi", "t", "z", "x").withColumns({"scan": F.lit(0), "zi": F.lit(1)})
    scan = Scan(n=6, nz=2, angles=4, level=0)
    tiles = shape(truth * gain * (1 + 1e-5) + offset * (1 - truth)).withColumn("crop_top", F.col("xi") + 7)
    out = corrected(tiles, scan, 2, 6, shape(np.broadcast_to(gain, (2, 3, 2, 6))), shape(np.broadcast_to(offset, (2, 2, 2, 6))))
    assert np.allclose(array(out, "xi", "t", "z", "x"), truth, atol=1e-4)
    assert {(r.xi, r.crop_top) for r in out.select("xi", "crop_top").distinct().collect()} == {(0, 7), (1, 8)}
    hot = np.broadcast_to(gain, (2, 5, 2, 6)).copy()
    hot[1, 2, 1, 3] += 1e5
    mended = corrected(tiles, Scan(n=6, nz=2, angles=4, level=0, dezinger=3), 2, 6, shape(hot), shape(np.broadcast_to(offset, (2, 2, 2, 6))))
    assert abs(array(mended, "xi", "t", "z", "x") / truth - 1).max() < 0.4


def test_a_sample_is_prepared_scan_by_scan(spark):
    draw = np.random.default_rng(3)
    a = draw.random((2, 3, 4, 4))
    volume = table(spark, a, "scan", "z", "y", "x")
    scan = Scan(n=8, nz=6, angles=4, factor=2, radius=3.0, taper=1.0, fade=2)
    found = array(prepared(volume, scan), "scan", "z", "y", "x")
    for k in range(2):
        one = array(enlarged(table(spark, a[k], "z", "y", "x"), 4, 2), "z", "y", "x")
        rho = np.hypot(*(np.indices((8, 8)) - 3.5))
        mask = 0.5 - 0.5 * np.cos(np.pi * np.clip((3 - rho) + 0.5, 0, 1))
        z = np.minimum(np.arange(6), 5 - np.arange(6))
        fade = np.where(z >= 2, 1.0, 0.5 - 0.5 * np.cos(np.pi * (z + 0.5) / 2))
        assert np.allclose(found[k], one * mask * fade[:, None, None], atol=1e-12)


def test_statistics_of_all_steps(spark):
    scan = Scan(n=16, nz=8, angles=4, level=0)
    volumes = model.grid(spark, scan=2, z=8, y=16, x=16).withColumn("v", F.col("scan") * 1e-3)
    geometry_ = volumes.select("scan").distinct().select("scan", *[F.lit(v).alias(c) for c, v in dict(det_h=5, det_w=6, overlap=2, inset=2, z_overlap=2, sample_r=8.0, sample_h=8.0, n=16, nz=8, z_pad=0).items()])
    found = {(r.step, r.scan): r for r in statistics(steps(volumes, geometry_, scan)).collect()}
    assert {s for s, _ in found} == {"sample", "projections", "intensities", "tiles", "corrected", "stitched", "phases", "volumes"}
    assert found["stitched", 1].n == 4 * 8 * 16 and found["volumes", 0].n == 8 * 16 * 16 and not any(r.has_nan for r in found.values())
    assert found["intensities", 0].least == pytest.approx(1.0) and found["intensities", 1].least < 1


def test_whole_scans_shuffle_lines(spark):
    """Planes are worked on many at once and whole lines are shuffled; elements that are 0 need no row; the steps' results."""
    draw = np.random.default_rng(11)
    v = 0.02 * draw.random((3, 8, 16, 16)) * (draw.random((3, 8, 16, 16)) < 0.5)
    v[2] = 0
    v[0, 3] = 0
    scan = Scan(n=16, nz=8, angles=12)
    scans = spark.createDataFrame([(k, 5, 6, 2, 2, 2, 8.0, 8.0, 16, 8, 0) for k in range(3)], "scan int, det_h int, det_w int, overlap int, inset int, z_overlap int, sample_r double, sample_h double, n int, nz int, z_pad int")
    volumes = table(spark, v, "scan", "z", "y", "x")
    expected = array(steps(volumes, scans, scan)["volumes"], "scan", "z", "y", "x")
    sparse = whole(volumes.where("v <> 0"), scans, scan, scans.select("scan"))
    for found in (whole(volumes, scans, scan), sparse):
        assert np.allclose(array(found, "scan", "z", "y", "x"), expected, rtol=0, atol=1e-12)
    plan = sparse._sc._jvm.PythonSQLUtils.explainString(sparse._jdf.queryExecution(), "simple")
    assert "FlatMapGroupsInPandas" not in plan
    by_strips = Scan(n=16, nz=8, angles=12, budget=40_000)
    assert np.allclose(array(whole(volumes.where("v <> 0"), scans, by_strips, scans.select("scan")), "scan", "z", "y", "x"), expected, rtol=0, atol=1e-9)
    with pytest.raises(Exception, match="lacks elements"):
        whole(volumes.where("scan <> 1 or z <> 3 or y <> 5 or x <> 7"), scans, scan).count()


def test_stacks_give_what_planes_give():
    draw = np.random.default_rng(12)
    image, sino = draw.standard_normal((5, 16, 16)), draw.standard_normal((5, 12, 16))
    t = radon.transform(16, 12)
    assert np.allclose(t.forward(image), [t.forward(x) for x in image], atol=1e-13)
    assert np.allclose(t.adjoint(sino), [t.adjoint(x) for x in sino], atol=1e-13)
    for shape in ((4, 24, 6), (3, 13, 9), (2, 40, 30)):
        v = draw.standard_normal(shape)
        assert np.allclose(stripe.removal(1.5, "sym16", 3)(v), [stripe.without_stripes(x, 1.5, "sym16", 3) for x in v], atol=1e-12)
    v = draw.standard_normal((2, 24, 6))
    v[1, 3, 2] = np.nan
    found = stripe.removal()(v)
    assert np.isfinite(found[0]).all() and np.isnan(found[1]).any()
