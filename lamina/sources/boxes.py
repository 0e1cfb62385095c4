"""Datasets laid out along a space-filling curve, so that a range of any axis, or a box, opens only the files that it meets.

Elements fall into blocks, whose numbers along the axes are interleaved bit by bit (Morton order). An aligned cube of blocks is
a cell: one value of the dataset's only partition column, whose bits tell where it lies on each axis. A reader of a range
compares those bits, so Spark rules out cells by their paths alone, when it plans; within a file blocks follow the same order,
so the least and most of each row group and page rule out most of what is left. A layout by bands of one axis, as in ``store``,
opens less for ranges of that axis and everything for the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a code, the sign left out: each axis has an equal share of them.
CODE_BITS = 63


@dataclass(frozen=True)
class Boxes:
    """block: how many elements a block has along each axis, by name. A cell has 2 ** levels blocks along each axis."""

    block: tuple[tuple[str, int], ...] = (("t", 32), ("z", 32), ("x", 64))
    levels: int = 3

    def __post_init__(self) -> None:
        if not self.block or len({a for a, _ in self.block}) != len(self.block):
            raise ValueError("a layout has at least one axis, and each once")
        if any(n < 1 for _, n in self.block):
            raise ValueError("a block has at least one element along each axis")
        if not 0 <= self.levels <= self.bits:
            raise ValueError(f"a cell has from 1 to 2 ** {self.bits} blocks along each axis")

    @property
    def axes(self) -> list[str]:
        return [a for a, _ in self.block]

    @property
    def bits(self) -> int:
        """Bits of a block's number along one axis."""
        return CODE_BITS // len(self.block)

    def width(self, axis: str) -> int:
        """Elements of a cell along the axis."""
        return dict(self.block)[axis] << self.levels


def interleaved(numbers: list[Column], bits: int) -> Column:
    """The bits of whole numbers >= 0 taken in turns, the last number's lowest bit first."""
    apart = len(numbers)
    terms = [F.shiftleft(n.bitwiseAND(F.lit(1 << j)), j * (apart - 1) + apart - 1 - k) for k, n in enumerate(numbers) for j in range(bits)]
    return reduce(Column.bitwiseOR, terms)


def taken_apart(code: Column, k: int, apart: int, bits: int) -> Column:
    """The k-th of the ``apart`` numbers that interleaved() made the code of."""
    terms = [F.shiftright(code, j * (apart - 1) + apart - 1 - k).bitwiseAND(F.lit(1 << j)) for j in range(bits)]
    return reduce(Column.bitwiseOR, terms)


def block_code(layout: Boxes) -> Column:
    """The Morton code of an element's block; an error for coordinates below 0 or past what the bits hold, null for null ones."""
    numbers = []
    for axis, n in layout.block:
        at = F.col(axis).cast("long")
        inside = (at >= 0) & (at < n << layout.bits) if (n << layout.bits) < 1 << 63 else at >= 0
        numbers.append(F.when(at.isNull() | inside, F.floor(at / n).cast("long") if n & (n - 1) else F.shiftright(at, n.bit_length() - 1)).otherwise(F.raise_error(F.concat(F.lit(f"{axis} is outside of the layout: "), at.cast("string"))).cast("long")))
    return interleaved(numbers, layout.bits)


def write(values: DataFrame, path: str, layout: Boxes = Boxes()) -> None:  # noqa: B008
    """Replaces the dataset at path by values, whose whole coordinates >= 0 are in the layout's axes.

    Rows are shuffled once, in ranges of code and coordinates: a cell with very many rows is several tasks' and several files',
    and a task that has many small cells writes a file for each. Repeated rows are kept, other columns too; rows with a null
    coordinate are in the whole dataset, but in no range. An empty table leaves an empty dataset.
    """
    code, cell = "_code", "cell"
    clashes = {code, cell} & set(values.columns)
    if clashes:
        raise ValueError(f"the layout needs the column names {', '.join(sorted(clashes))} itself")
    coded = values.withColumn(code, block_code(layout))
    placed = coded.withColumn(cell, F.shiftright(code, len(layout.block) * layout.levels)).repartitionByRange(code, *layout.axes).sortWithinPartitions(cell, code, *layout.axes)
    placed.drop(code).write.mode("overwrite").partitionBy(cell).option("parquet.page.row.count.limit", 4096).parquet(path)


def read(spark: SparkSession, path: str, ranges: dict[str, tuple[int | None, int | None]] | None = None, layout: Boxes = Boxes(), schema: str | None = None) -> DataFrame:  # noqa: B008
    """The dataset at path, or its elements with low <= axis < high for each of the ranges {axis: (low, high)}; None leaves an
    end open. Cells outside aren't opened. A schema spares Spark the look into a file, and is needed for an empty dataset.

    layout is the one it was written with.
    """
    reader = spark.read.schema(f"{schema}, cell long") if schema else spark.read
    values = reader.parquet(path)
    apart = len(layout.block)
    number = {a: taken_apart(F.col("cell").cast("long"), k, apart, layout.bits - layout.levels) for k, a in enumerate(layout.axes)}
    for axis, (low, high) in (ranges or {}).items():
        if axis not in number:
            raise ValueError(f"unknown axis {axis}; expected one of {', '.join(layout.axes)}")
        width = layout.width(axis)
        if low is not None:
            values = values.where((F.col(axis) >= low) & (number[axis] >= max(low, 0) // width))
        if high is not None:
            values = values.where((F.col(axis) < high) & (number[axis] <= (high - 1) // width))
    return values.drop("cell")
