import random

import pytest
from pyspark.sql import functions as F

from lamina.sources import boxes, store

LAYOUT = boxes.Boxes((("t", 4), ("z", 3), ("x", 8)), levels=1)


@pytest.fixture(scope="module")
def volume(spark, tmp_path_factory):
    """32 x 24 x 32 elements, laid out in boxes and, for comparison, in bands of t."""
    values = spark.range(32 * 24 * 32).select(
        F.expr("cast(id div 768 as int)").alias("t"), F.expr("cast(id div 32 % 24 as int)").alias("z"), F.expr("cast(id % 32 as int)").alias("x"), F.col("id").cast("float").alias("v")
    )
    at = tmp_path_factory.mktemp("boxes")
    boxes.write(values, str(at / "boxes"), LAYOUT)
    store.write(values, str(at / "bands"), "proj", band=8)
    return values, str(at / "boxes"), str(at / "bands")


def opened(df):
    """The files that the scan of a plan without a shuffle opens, and the rows of the result."""
    execution = df._jdf.queryExecution()
    rows = execution.executedPlan().executeCollect()
    leaf = execution.executedPlan().collectLeaves().head()
    return leaf.metrics().get("numFiles").get().value(), len(rows)


def test_codes_are_interleaved_bits(spark):
    def expected(numbers, bits):
        return sum((n >> j & 1) << (j * len(numbers) + len(numbers) - 1 - k) for k, n in enumerate(numbers) for j in range(bits))

    for apart, bits in ((1, 62), (2, 31), (3, 21)):
        rng = random.Random(apart)
        rows = [tuple(rng.choice([0, 1, (1 << bits) - 1, rng.getrandbits(bits)]) for _ in range(apart)) for _ in range(50)]
        names = [f"n{k}" for k in range(apart)]
        coded = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).withColumn("code", boxes.interleaved([F.col(n) for n in names], bits))
        back = [boxes.taken_apart(F.col("code"), k, apart, bits).alias(f"b{k}") for k in range(apart)]
        for r in coded.select("*", *back).collect():
            assert r.code == expected(r[:apart], bits)
            assert r[apart + 1 :] == r[:apart]


def test_every_axis_prunes_files(spark, volume):
    values, path, bands = volume
    whole, n = opened(boxes.read(spark, path, layout=LAYOUT))
    assert n == 32 * 24 * 32
    cells = 4 * 4 * 2  # of 8 x 6 x 16 elements
    assert cells <= whole <= cells + spark.sparkContext.defaultParallelism * 2
    for axis, low, high, share in (("t", 8, 16, 4), ("z", 6, 12, 4), ("x", 16, 32, 2)):
        files, n = opened(boxes.read(spark, path, {axis: (low, high)}, LAYOUT))
        assert n == values.where((F.col(axis) >= low) & (F.col(axis) < high)).count()
        assert files <= whole / share + 8
    files, n = opened(boxes.read(spark, path, {"t": (9, 15), "z": (7, 11), "x": (3, 9)}, LAYOUT))
    assert (n, files <= 4) == (6 * 4 * 6, True)
    # Bands of one axis open all files for a range of another.
    everything, _ = opened(store.read(spark, bands))
    assert opened(store.read(spark, bands).where("z >= 6 and z < 12"))[0] == everything


def test_reads_are_the_elements_asked_for(spark, volume):
    values, path, _ = volume
    rng = random.Random(1)
    for _ in range(6):
        ranges = {a: tuple(sorted((rng.randint(-3, n + 3), rng.randint(-3, n + 3)))) for a, n in rng.sample((("t", 32), ("z", 24), ("x", 32)), rng.randint(1, 3))}
        wanted = values
        for a, (low, high) in ranges.items():
            wanted = wanted.where((F.col(a) >= low) & (F.col(a) < high))
        found = boxes.read(spark, path, ranges, LAYOUT)
        assert sorted(found.select("t", "z", "x", "v").collect()) == sorted(wanted.collect())
    assert boxes.read(spark, path, {"t": (None, 5)}, LAYOUT).count() == 5 * 24 * 32
    assert boxes.read(spark, path, {"t": (30, None)}, LAYOUT).count() == 2 * 24 * 32
    assert boxes.read(spark, path, {"z": (5, 5)}, LAYOUT).count() == 0


def test_repeated_null_and_outside_rows(spark, tmp_path):
    layout = boxes.Boxes((("t", 4), ("x", 4)), levels=2)
    rows = [(0, 0, 1.0, "a"), (0, 0, 1.0, "a"), (50, 3, None, None), (None, 3, 2.0, "b"), (7, None, 3.0, "c")]
    boxes.write(spark.createDataFrame(rows, "t int, x int, v double, note string"), str(tmp_path / "a"), layout)
    key = lambda r: tuple((c is None, c or 0) if not isinstance(c, str) else (False, c) for c in r[:3])
    assert sorted(map(tuple, boxes.read(spark, str(tmp_path / "a"), layout=layout).select("t", "x", "v", "note").collect()), key=key) == sorted(rows, key=key)
    assert boxes.read(spark, str(tmp_path / "a"), {"t": (0, 10)}, layout).count() == 2
    empty = spark.createDataFrame([], "t int, x int, v double")
    boxes.write(empty, str(tmp_path / "b"), layout)
    assert boxes.read(spark, str(tmp_path / "b"), {"t": (0, 10)}, layout, schema="t int, x int, v double").count() == 0
    for t in (-1, 4 << 31):
        with pytest.raises(Exception, match="outside of the layout"):
            boxes.write(spark.createDataFrame([(t, 0)], "t long, x int"), str(tmp_path / "c"), layout)
    with pytest.raises(ValueError, match="cell"):
        boxes.write(empty.withColumn("cell", F.lit(1)), str(tmp_path / "d"), layout)
    with pytest.raises(ValueError, match="unknown axis"):
        boxes.read(spark, str(tmp_path / "a"), {"z": (0, 1)}, layout)
    for wrong in ({"block": ()}, {"block": (("t", 0),)}, {"block": (("t", 1), ("t", 2))}, {"levels": 40}):
        with pytest.raises(ValueError):
            boxes.Boxes(**wrong)


def test_a_large_cell_is_several_files(spark, tmp_path):
    layout = boxes.Boxes((("t", 64), ("x", 64)), levels=3)  # all in one cell
    values = spark.range(40_000).select((F.col("id") % 200).alias("t"), F.expr("id div 200").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task's
    try:
        boxes.write(values, str(tmp_path / "one"), layout)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files, n = opened(boxes.read(spark, str(tmp_path / "one"), layout=layout))
    assert n == 40_000 and files > 1
