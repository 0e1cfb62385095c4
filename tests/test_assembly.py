"""Tiles that arrive line by line are stitched to what a batch of them is."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lamina.operators import geometry, model, mosaic
from lamina.streaming import assembly

START = datetime(2024, 1, 1)


def tiles_of(spark):
    scans = spark.createDataFrame([(s, 12, 16, 4, 4, 4, s * 4 + 6.0, 18.0, 40, 24, 3) for s in (0, 1)], "scan int, det_h int, det_w int, overlap int, inset int, z_overlap int, sample_r double, sample_h double, n int, nz int, z_pad int")
    return geometry.footprints(geometry.placements(scans))


def run(spark, path, batches, tiles, name, band=64):
    """Each batch of lines is a file, read in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, assembly.LINE).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
        query = (
            assembly.stitched(spark.readStream.schema(assembly.LINE).parquet(f"{path}/{name}"), tiles, 2, "1 minute", 60, band)
            .writeStream.format("parquet").option("path", f"{path}/{name}-out").option("checkpointLocation", f"{path}/{name}-at").start()
        )
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(f"{path}/{name}-out")


@pytest.fixture(scope="module")
def cut(spark):
    tiles = tiles_of(spark)
    stack = model.grid(spark, scan=2, t=2, z=24, x=40).withColumn("v", F.sin(F.col("z") * 3.7 + F.col("x") * 1.3 + F.col("t") + F.col("scan")) + 2)
    # Tiles that differ, so that the weights count.
    pixels = mosaic.cut(stack, tiles, 2).withColumn("v", F.col("v") + 10 * F.col("zi") + F.col("xi"))
    lines = [tuple(r) for r in model.to_rows(pixels, "scan", "zi", "xi", "t", "z").orderBy(F.xxhash64("scan", "zi", "xi", "t", "z")).collect()]
    want = {(r.scan, r.t, r.z, r.x): r.v for r in mosaic.stitched(pixels, tiles, 2).collect()}
    return tiles, lines, want


def test_any_order_gives_the_batch(spark, tmp_path, cut):
    tiles, lines, want = cut
    third = len(lines) // 3
    parts = [lines[:third], lines[third : 2 * third] + lines[:50], lines[2 * third :] + lines[-9:]]  # some come twice
    rows = run(spark, tmp_path, [[(*r, START + timedelta(seconds=k)) for r in part] for k, part in enumerate(parts)], tiles, "all", 10).collect()
    found = {(r.scan, r.t, r.z, r.x): r.v for r in rows}
    assert len(rows) == len(found) and all(r.complete for r in rows) and set(found) == set(want)
    assert max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_a_lost_tile_is_waited_for_and_given_up(spark, tmp_path, cut):
    tiles, lines, want = cut
    kept = [r for r in lines if not (r[0] == 0 and r[1] == 0 and r[2] == 0 and r[3] % 2 == 1)]
    strangers = [(9, 0, 0, 0, 0, [1.0], START + timedelta(minutes=m)) for m in (1, 20)]  # of no catalog
    late = [[(*r, START) for r in kept] + strangers[:1], [*strangers[1:], (*lines[0], START + timedelta(minutes=20))], [(*lines[0], START + timedelta(minutes=20))]]
    rows = run(spark, tmp_path, late, tiles, "lost").collect()
    assert {(r.scan, r.t) for r in rows if not r.complete} == {(0, 1)}
    assert all(abs(want[r.scan, r.t, r.z, r.x] - r.v) < 1e-9 for r in rows if r.complete)
    assert {(r.scan, r.t) for r in rows if r.complete} == {(0, 0), (1, 0), (1, 1)}
