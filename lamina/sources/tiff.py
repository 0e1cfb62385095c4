"""Stacks of pages in uncompressed TIFF files, as a data source of Spark: ``spark.read.format("tiff_pages")``.

Filters on z and y are pushed down: a task reads a range of pages of one file, of these only the directories and elements that
are asked for. To find the pages of one file the driver follows its chain of directories, and keeps one place for each task. A
folder is a stack whose files' names end in the number of their first page, as write() leaves them: a file is a task there,
which the driver doesn't open.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

#: Pages of a task, and bytes of rows that are handed to Spark at once.
PAGES, BATCH_BYTES = 64, 8 << 20
#: Tags of the format, sizes and codes of its field types, and names of its sample formats.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
FIELDS = {1: "B", 3: "H", 4: "I", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}


def opened(path: str):
    """The file system of a path (a URI, or local to all machines), and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


class Directories:
    """The pages' directories of one file; which are a chain, so that a page is found through those before it."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(16, 0)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        self.order = "<" if head[:2] == b"II" else ">"
        (version,) = struct.unpack(self.order + "H", head[2:4])
        if version not in (42, 43):
            raise ValueError(f"not a TIFF file: version {version}")
        self.big = version == 43
        # Of a directory: the count of its entries, an entry, and an offset.
        self.count, self.entry, self.offset = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        (self.first,) = struct.unpack(self.order + self.offset, head[8:16] if self.big else head[4:8])

    def _numbers(self, code: str, at: int, n: int = 1) -> tuple:
        size = struct.calcsize(self.order + code) * n
        data = self.file.read_at(size, at)
        if len(data) < size:
            raise ValueError("the file ends within a directory")
        return struct.unpack(f"{self.order}{n}{code}", data)

    def next(self, at: int) -> int:
        """Where the directory after the one at ``at`` is; 0 after the last."""
        (n,) = self._numbers(self.count, at)
        return self._numbers(self.offset, at + struct.calcsize(self.order + self.count) + n * self.entry)[0]

    def starts(self, every: int) -> tuple[list[int], int]:
        """Where each ``every``-th directory is, and how many there are."""
        found, n, at = [], 0, self.first
        last = self.file.size()
        while at:
            if n > last // self.entry:
                raise ValueError("the directories of the file are a cycle")
            if n % every == 0:
                found.append(at)
            n, at = n + 1, self.next(at)
        return found, n

    def tags(self, at: int) -> dict[int, tuple]:
        """The whole-number fields of a directory."""
        (n,) = self._numbers(self.count, at)
        data = self.file.read_at(n * self.entry, at + struct.calcsize(self.order + self.count))
        out = {}
        inline = self.entry // 2 - 2  # bytes of a value within its entry: 4, or 8
        for k in range(n):
            one = data[k * self.entry : (k + 1) * self.entry]
            tag, kind = struct.unpack(self.order + "HH", one[:4])
            (many,) = struct.unpack(self.order + self.offset, one[4 : 4 + struct.calcsize(self.order + self.offset)])
            code = FIELDS.get(kind)
            if code is None:
                continue
            size, value = struct.calcsize(code) * many, one[-inline:]
            if size <= inline:
                out[tag] = struct.unpack(f"{self.order}{many}{code}", value[:size])
            else:
                out[tag] = self._numbers(code, struct.unpack(self.order + self.offset, value)[0], many)
        return out

    def rows(self, at: int, low: int, high: int | None) -> Iterator[tuple[int, np.ndarray]]:
        """The lines low <= y < high of the page whose directory is at ``at``, strip by strip: the first one's y, and values."""
        tags = self.tags(at)
        if tags.get(COMPRESSION, (1,))[0] != 1 or OFFSETS not in tags or tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("only uncompressed pages of strips with one sample an element are read")
        bits, kind = tags.get(BITS, (1,))[0], KINDS.get(tags.get(FORMAT, (1,))[0])
        if kind is None or bits not in ((8, 16, 32, 64) if kind != "f" else (16, 32, 64)):
            raise ValueError(f"elements of {bits} bits in this format aren't read")
        dtype = np.dtype(f"{self.order}{kind}{bits // 8}")
        width, length = tags[WIDTH][0], tags[LENGTH][0]
        high = length if high is None else min(high, length)
        each = min(tags.get(ROWS, (length,))[0], length)
        most = max(1, BATCH_BYTES // max(1, width * dtype.itemsize))
        for strip, offset in enumerate(tags[OFFSETS]):
            first, last = max(low, strip * each), min(high, (strip + 1) * each)
            for y in range(first, last, most):
                n = min(most, last - y)
                data = self.file.read_at(n * width * dtype.itemsize, offset + (y - strip * each) * width * dtype.itemsize)
                if len(data) < n * width * dtype.itemsize:
                    raise ValueError("the file ends within a page")
                yield y, np.frombuffer(data, dtype).reshape(n, width)


@dataclass
class Pages(ds.InputPartition):
    """Some pages of a file: where the first one's directory is, its number in the stack, and how many there are.

    Of a whole file neither the place nor the count is known yet.
    """

    path: str
    at: int | None
    z: int
    count: int | None


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages
        #: Ranges [low, high) of z and y that are asked for; high None is open.
        self.ranges: dict[str, list] = {"z": [0, None], "y": [0, None]}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if isinstance(f, ds.IsNotNull) and f.attribute in (("z",), ("y",)):
                continue  # neither is ever null
            axis = getattr(f, "attribute", ("",))[0]
            if axis not in self.ranges or len(f.attribute) > 1 or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, ds.EqualTo):
                self._narrow(axis, f.value, f.value + 1)
            elif isinstance(f, ds.GreaterThan):
                self._narrow(axis, f.value + 1, None)
            elif isinstance(f, ds.GreaterThanOrEqual):
                self._narrow(axis, f.value, None)
            elif isinstance(f, ds.LessThan):
                self._narrow(axis, 0, f.value)
            elif isinstance(f, ds.LessThanOrEqual):
                self._narrow(axis, 0, f.value + 1)
            else:
                yield f

    def _narrow(self, axis: str, low: int, high: int | None) -> None:
        known = self.ranges[axis]
        known[0] = max(known[0], low)
        if high is not None:
            known[1] = max(0, high) if known[1] is None else min(known[1], max(0, high))

    def partitions(self) -> list[Pages]:
        low, high = self.ranges["z"]
        system, path = opened(self.path)
        if system.get_file_info(path).type == pyarrow.fs.FileType.File:
            with system.open_input_file(path) as file:
                starts, n = Directories(file).starts(self.pages)
            every = [Pages(self.path, at, j * self.pages, min(self.pages, n - j * self.pages)) for j, at in enumerate(starts)]
            out = [p for p in every if p.z + p.count > low and (high is None or p.z < high)]
        else:
            names = [i.base_name for i in system.get_file_info(pyarrow.fs.FileSelector(path))]
            files = sorted((int(m[1]), n) for n in names if (m := re.match(r"[^._].*?(\d+)\.tiff?$", n)))
            ends = [*[z for z, _ in files[1:]], None]  # a file ends where the next begins
            out = [Pages(f"{self.path.rstrip('/')}/{n}", None, z, None) for (z, n), end in zip(files, ends, strict=False) if (end is None or end > low) and (high is None or z < high)]
        # Spark asks for one part at least.
        return out or [Pages("", None, 0, 0)]

    def read(self, part: Pages) -> Iterator[pa.RecordBatch]:
        if part.count == 0:
            return
        (low, high), (y_low, y_high) = self.ranges["z"], self.ranges["y"]
        system, path = opened(part.path)
        with system.open_input_file(path) as file:
            pages = Directories(file)
            z, at = part.z, pages.first if part.at is None else part.at
            # A chain that is a cycle has more pages than the file has room for.
            end = z + (file.size() // pages.entry + 1 if part.count is None else part.count)
            while at and z < end and (high is None or z < high):
                if z >= low:
                    for y, values in pages.rows(at, y_low, y_high):
                        n, width = values.shape
                        lines = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, values.astype(np.float32).ravel())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, z, np.int32)), pa.array(np.arange(y, y + n, dtype=np.int32)), lines], ["z", "y", "row"])
                z, at = z + 1, pages.next(at)
            if part.count is None and at and z == end:
                raise ValueError("the directories of the file are a cycle")


@dataclass
class Written(ds.WriterCommitMessage):
    """A file as a task left it, and the name it is to have (None: the task had no rows)."""

    name: str | None
    final: str | None


class Writer(ds.DataSourceArrowWriter):
    """A file of each task, under a name of its own until all tasks are done: a task that is run again leaves no page twice."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = opened(self.path)
        system.create_dir(path)
        name = f"{path}/_{uuid.uuid4().hex}"
        first, n, lines = 0, 0, _lines(batches)
        with system.open_output_stream(name) as out:
            # Offsets have 64 bits at any size; a directory precedes its page, the first one begins at 16.
            out.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))
            at = 16
            for z, rows in lines:
                first = z if n == 0 else first
                if z != first + n:
                    raise ValueError(f"page {first + n} is missing before page {z}")
                page = np.ascontiguousarray(rows, "<f4")
                length, width = page.shape
                fields = [(WIDTH, 4, width), (LENGTH, 4, length), (BITS, 3, 32), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 16, 0), (SAMPLES, 3, 1), (ROWS, 4, length), (COUNTS, 16, page.nbytes), (FORMAT, 3, 3)]
                begin = at + 8 + 20 * len(fields) + 8
                entries = b"".join(struct.pack("<HHQQ", tag, kind, 1, begin if tag == OFFSETS else value) for tag, kind, value in fields)
                n, at = n + 1, begin + page.nbytes
                out.write(struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", 0 if lines.last else at))
                out.write(page.tobytes())
        if n == 0:
            system.delete_file(name)
            return Written(None, None)
        return Written(name, f"{path}/pages-{first:010d}.tif")

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        system.create_dir(path)
        final = {m.final: m.name for m in messages if m and m.name}
        for to, name in final.items():
            system.move(name, to)
        if self.overwrite:
            for i in system.get_file_info(pyarrow.fs.FileSelector(path)):
                if re.match(r"pages-\d+\.tif$", i.base_name) and i.path not in final:
                    system.delete_file(i.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(m.name)


class _lines:
    """Whole pages (z, lines) of batches that are in the order of z and y; ``last`` says whether the one just given is the last."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.pages, self.last = self._gathered(batches), False

    @staticmethod
    def _gathered(batches) -> Iterator[tuple[int, np.ndarray]]:
        z, rows = None, []
        for batch in batches:
            column = batch.column("row")
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for k, (own, y) in enumerate(zip(batch.column("z").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                if own != z:
                    if rows:
                        yield z, np.stack(rows)
                    z, rows = own, []
                if y != len(rows):
                    raise ValueError(f"page {own} has no line {len(rows)}, or has one twice")
                rows.append(values[offsets[k] : offsets[k + 1]].astype(np.float32))
        if rows:
            yield z, np.stack(rows)

    def __iter__(self):
        held = None
        for page in self.pages:
            if held is not None:
                yield held
            held = page
        self.last = True
        if held is not None:
            yield held


class TiffPages(ds.DataSource):
    """Options: ``path``, a file or a folder; ``pages``, how many a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self) -> str:
        return "z int, y int, row array<float>"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("pages", PAGES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffPages)


def read(spark: SparkSession, path: str, pages: int = PAGES) -> DataFrame:
    """(z, y, row) of the file or folder. Ranges of z and y are pushed down. An empty folder has no rows; a file that is no
    TIFF, is compressed, tiled, cut off, or has several samples an element is an error when it is read."""
    registered(spark)
    return spark.read.format("tiff_pages").option("path", path).option("pages", pages).load()


def write(rows: DataFrame, path: str, pages: int = PAGES) -> None:
    """Replaces the stack in the folder at path by (z, y, row): files of ``pages`` pages each, as 32-bit numbers.

    All lines from 0 on of each page must be there, of one length; other columns are left out. A page must fit a task.
    """
    registered(rows.sparkSession)
    if pages < 1:
        raise ValueError("a file has at least one page")
    first = rows.select(F.col("z").cast("int").alias("z"), F.col("y").cast("int").alias("y"), F.col("row").cast("array<float>").alias("row"))
    last = first.agg(F.max("z")).first()[0] or 0
    dealt = first.repartitionById(last // pages + 1, F.floor(F.col("z") / pages).cast("int"))
    dealt.sortWithinPartitions("z", "y").select("z", "y", "row").write.format("tiff_pages").mode("overwrite").option("path", path).save()
