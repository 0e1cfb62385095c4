"""Stacks in TIFF files: read from bytes that are put together here, pruned by filters, and written."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from lamina.sources import tiff


def made(pages, order="<", strip=2, kind=3, compression=1):
    """A classic file of pages, written field by field; the pages come first, each in strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        length, width = page.shape
        size = page.dtype.itemsize
        offsets, counts = [], []
        for y in range(0, length, strip):
            part = page[y : y + strip].astype(page.dtype.newbyteorder(order)).tobytes()
            offsets.append(len(out))
            counts.append(len(part))
            out += part
        places = []
        for values in (offsets, counts):
            places.append(len(out))
            out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", 9)
        short = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
        long = lambda tag, v: struct.pack(order + "HHII", tag, 4, 1, v)
        many = lambda tag, at, values: struct.pack(order + "HHII", tag, 4, len(values), at if len(values) > 1 else values[0])
        out += short(256, width) + long(257, length) + short(258, 8 * size) + short(259, compression)
        out += many(273, places[0], offsets) + short(277, 1) + short(278, strip) + many(279, places[1], counts) + short(339, kind)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def stack_of(rows):
    found = sorted(rows.collect())
    return {(r.z, r.y): r.row for r in found}


@pytest.mark.parametrize(("order", "dtype", "kind"), [("<", "u2", 1), (">", "f4", 3), (">", "i4", 2), ("<", "u1", 1), ("<", "f8", 3)])
def test_a_file_is_read(spark, tmp_path, order, dtype, kind):
    pages = (np.random.default_rng(1).normal(size=(7, 5, 6)) * 50 + 60).astype(dtype)
    (tmp_path / "a.tif").write_bytes(made(pages, order, kind=kind))
    found = stack_of(tiff.read(spark, str(tmp_path / "a.tif"), pages=3))
    assert set(found) == {(z, y) for z in range(7) for y in range(5)}
    assert all(np.array_equal(found[z, y], pages[z, y].astype("f4")) for z, y in found)


def test_filters_choose_what_is_read(spark, tmp_path):
    pages = np.arange(40 * 6 * 4, dtype="f4").reshape(40, 6, 4)
    path = str(tmp_path / "a.tif")
    (tmp_path / "a.tif").write_bytes(made(pages))
    some = tiff.read(spark, path, pages=4).where("z >= 13 and z < 18 and y > 1 and y <= 4 and size(row) = 4")
    assert set(stack_of(some)) == {(z, y) for z in range(13, 18) for y in range(2, 5)}
    assert some.rdd.getNumPartitions() == 2  # of ten
    assert tiff.read(spark, path).where("z = 50 or z = 3").count() == 6  # not pushed down
    assert tiff.read(spark, path).where("z > 39").count() == 0 and tiff.read(spark, path).where("z < 0").count() == 0
    reader = tiff.Reader(path, 4)
    left = ds.In(("z",), (1, 2))
    assert list(reader.pushFilters([ds.GreaterThan(("z",), 20), ds.LessThanOrEqual(("z",), 25), left, ds.EqualTo(("y",), 3)])) == [left]
    assert [(p.z, p.count) for p in reader.partitions()] == [(20, 4), (24, 4)]
    # Only the asked pages' one line of each is read: the others could be missing.
    rows = [b.to_pydict() for p in reader.partitions() for b in reader.read(p)]
    assert [(r["z"], r["y"]) for r in rows] == [([z], [3]) for z in range(21, 26)]


def test_a_stack_is_written_and_read(spark, tmp_path):
    path = str(tmp_path / "stack")
    rows = spark.range(23 * 4).select((F.col("id") % 23).alias("z"), F.floor(F.col("id") / 23).alias("y")).withColumn("row", F.array(*[(F.col("z") * 100 + F.col("y") * 10 + k).cast("double") for k in range(5)])).withColumn("other", F.lit("x"))
    tiff.write(rows, path, pages=5)
    assert sorted(os.listdir(path)) == [f"pages-{z:010d}.tif" for z in range(0, 23, 5)]
    back = tiff.read(spark, path, pages=2)
    assert sorted(back.collect()) == sorted(rows.select(F.col("z").cast("int"), F.col("y").cast("int"), F.col("row").cast("array<float>")).collect())
    # Files without an asked page aren't opened.
    (tmp_path / "stack" / f"pages-{0:010d}.tif").write_bytes(b"broken")
    assert back.where("z between 6 and 11").count() == 24
    tiff.write(rows.where("z < 3"), path, pages=5)
    assert os.listdir(path) == [f"pages-{0:010d}.tif"] and tiff.read(spark, path).count() == 12
    tiff.write(rows.where("false"), path)
    assert tiff.read(spark, path).count() == 0
    with pytest.raises(Exception, match="no line 1"):
        tiff.write(rows.where("y <> 1"), path)
    with pytest.raises(Exception, match="page 7 is missing"):
        tiff.write(rows.where("z <> 7"), path)
    assert not [n for n in os.listdir(path) if n.endswith(".tif")]  # a failed write leaves the stack as it was


@pytest.mark.parametrize(
    ("data", "what"),
    [(b"abc", "not a TIFF"), (made(np.zeros((1, 2, 2), "f4"), compression=5), "uncompressed"), (made(np.zeros((2, 2, 2), "f4"), kind=6), "aren't read"), (made(np.zeros((2, 4, 4), "f4"))[:200], "ends within")],
)
def test_what_cannot_be_read_is_an_error(spark, tmp_path, data, what):
    (tmp_path / "a.tif").write_bytes(data)
    with pytest.raises(Exception, match=what):
        tiff.read(spark, str(tmp_path / "a.tif")).collect()


def test_a_cycle_of_directories_is_an_error(tmp_path):
    data = bytearray(made(np.zeros((1, 2, 2), "f4")))
    data[-4:] = data[4:8]
    (tmp_path / "a.tif").write_bytes(bytes(data))
    with pytest.raises(ValueError, match="cycle"):
        tiff.Reader(str(tmp_path / "a.tif"), 1).partitions()
    folder = tiff.Reader(str(tmp_path), 1)
    (tmp_path / "a.tif").rename(tmp_path / "a0.tif")
    with pytest.raises(ValueError, match="cycle"):
        [list(folder.read(p)) for p in folder.partitions()]
