"""Datasets in storage: Parquet tables laid out for the next reader, the plan of their parts, and the text catalog of a mosaic."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.mosaic import checked

CATALOG_KEYS = ("NZ", "N", "DET_H", "DET_W", "n_z", "n_x", "NTHETA", "N_HALF", "OVERLAP")
CATALOG_COLUMNS = ("zi", "xi", "z_center", "x_center", "crop_top", "crop_bottom", "crop_left", "crop_right")
LAYOUTS = {"proj": "t", "slice": "z"}


def bank(index: Column, chunk: int, banks: int) -> Column:
    """The bank of an index when every ``chunk`` of them is cut into ``banks`` equal parts, the last one shorter."""
    part = -(-chunk // banks)
    return (F.floor((index % chunk) / part) + banks * F.floor(index / chunk)).cast("int")


def write(values: DataFrame, path: str, layout: str = "proj", band: int = 64) -> None:
    """Replaces the dataset at path. ``proj`` keeps neighbouring projections together, ``slice`` neighbouring slices: files are
    partitioned by bands of that axis and sorted within, so that a reader of a range opens only what it needs."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}; expected one of {', '.join(LAYOUTS)}")
    if band < 1:
        raise ValueError("a band has at least one line")
    axis = LAYOUTS[layout]
    rest = [c for c in ("t", "z", "y", "x") if c in values.columns and c != axis]
    banded = values.withColumn("band", F.floor(F.col(axis) / band).cast("int")).repartitionByRange("band", axis).sortWithinPartitions("band", axis, *rest)
    banded.write.mode("overwrite").partitionBy("band").option("lamina.layout", layout).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a dataset at path."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return False
    return True


def write_banks(values: DataFrame, path: str, layout: str = "proj", chunk: int = 64, banks: int = 4) -> None:
    """A new dataset whose files are split by bank(); an error if there is one at path. The last bank of a chunk may be shorter."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}; expected one of {', '.join(LAYOUTS)}")
    if exists(values.sparkSession, path):
        raise ValueError(f"a dataset exists at {path}")
    axis = LAYOUTS[layout]
    banked = values.withColumn("bank", bank(F.col(axis), chunk, min(banks, chunk)))
    banked.repartitionByRange("bank", axis).sortWithinPartitions("bank", axis).write.partitionBy("bank").parquet(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles (scan, zi, xi, t, z, x, v, and what else each tile has): a folder for each, its pixels in order."""
    tiles.repartitionByRange("scan", "zi", "xi", "t").sortWithinPartitions("scan", "zi", "xi", "t", "z", "x").write.mode("overwrite").partitionBy("scan", "zi", "xi").parquet(path)


def read_tiles(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """The pixels of the catalog's tiles (scan, zi, xi); an error if one of them has no folder."""
    return checked(spark.read.parquet(path), catalog).join(F.broadcast(catalog.select("scan", "zi", "xi")) if catalog.count() <= 1_000_000 else catalog.select("scan", "zi", "xi"), ["scan", "zi", "xi"])


def read(spark: SparkSession, path: str, axis: str | None = None, low: int = 0, high: int | None = None, band: int = 64) -> DataFrame:
    """The dataset, or the lines low <= axis < high of the axis it is laid out by: bands outside aren't opened."""
    values = spark.read.parquet(path)
    if axis is not None:
        values = values.where((F.col(axis) >= low) & (F.col("band") >= low // band))
        if high is not None:
            values = values.where((F.col(axis) < high) & (F.col("band") <= (high - 1) // band))
    return values.drop("band")


def slab(values: DataFrame, axis: str, low: int, high: int) -> DataFrame:
    return values.where((F.col(axis) >= low) & (F.col(axis) < high))


def chunks(shapes: DataFrame) -> DataFrame:
    """A row per chunk of arrays (n0, n1, n2) cut into c0 x c1 x c2: the last ones are shorter; the middle axis runs fastest."""
    count = lambda k: F.ceil(F.col(f"n{k}") / F.col(f"c{k}")).cast("int")
    rows = shapes
    for k in (0, 2, 1):
        rows = rows.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), count(k) - 1)))
    sizes = {f"s{k}": F.least(F.col(f"c{k}"), F.col(f"n{k}") - F.col(f"i{k}") * F.col(f"c{k}")) for k in range(3)}
    order = (F.col("i0") * count(2) + F.col("i2")) * count(1) + F.col("i1")
    return rows.withColumns(sizes | {"position": order.cast("int"), "bytes": (sizes["s0"] * sizes["s1"] * sizes["s2"] * 4).cast("long")})


def task_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (low, high, tasks, align) cut into at most ``tasks`` parts, none empty, that begin at multiples of align."""
    first = F.floor(F.col("low") / F.col("align"))
    units = F.ceil(F.col("high") / F.col("align")) - first
    each = F.ceil(units / F.least(F.col("tasks"), units))
    rows = ranges.withColumns({"_first": first, "_each": each}).withColumn("task", F.explode(F.sequence(F.lit(0), (F.ceil(units / each) - 1).cast("int"))))
    edge = lambda k: (F.col("_first") + k * F.col("_each")) * F.col("align")
    return rows.withColumns({"task_low": F.greatest(F.col("low"), edge(F.col("task"))).cast("long"), "task_high": F.least(F.col("high"), edge(F.col("task") + 1)).cast("long")}).drop("_first", "_each")


def shape(values: DataFrame, *axes: str) -> DataFrame:
    """One row: the size of each axis, and the rows stored."""
    return values.agg(*[(F.max(a) + 1).alias(f"n_{a}") for a in axes], F.count("*").alias("rows"))


def described(values: DataFrame) -> str:
    """The planned scan, as text."""
    return "\n".join([", ".join(f"{n} {t}" for n, t in values.dtypes), values._sc._jvm.PythonSQLUtils.explainString(values._jdf.queryExecution(), "formatted")])


def catalog_lines(tiles: DataFrame, header: dict[str, int]) -> DataFrame:
    """The text catalog of a mosaic as lines: its parameters, then a row per tile."""
    missing = [k for k in CATALOG_KEYS if k not in header]
    if missing:
        raise ValueError(f"the catalog's header lacks {', '.join(missing)}")
    head = tiles.sparkSession.range(1).select(F.lit(-1).alias("zi"), F.lit(-1).alias("xi"), F.lit("# " + " ".join(f"{k}={header[k]}" for k in CATALOG_KEYS)).alias("value"))
    rows = tiles.select("zi", "xi", F.concat_ws(" ", *CATALOG_COLUMNS).alias("value"))
    return head.unionByName(rows).orderBy("zi", "xi").select("value")


def read_catalog(lines: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """The header of a text catalog, and its tiles with the header's sizes as columns."""
    heads = lines.where(F.col("value").startswith("#")).select(F.explode(F.regexp_extract_all("value", F.lit(r"(\w+\s*=\s*-?\d+)"), 1)).alias("p"))
    header = {k.strip(): int(v) for k, v in (r.p.split("=") for r in heads.where(F.regexp_extract("p", r"(\w+)", 1).isin(*CATALOG_KEYS)).distinct().collect())}  # one value for each key
    missing = [k for k in CATALOG_KEYS if k not in header]
    if missing:
        raise ValueError(f"the catalog's header lacks {', '.join(missing)}")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*[parts[i].cast("int").alias(c) for i, c in enumerate(CATALOG_COLUMNS)])
    return header, rows.select("*", *[F.lit(header[k]).alias(c) for k, c in (("NZ", "nz"), ("N", "n"), ("DET_H", "det_h"), ("DET_W", "det_w"), ("OVERLAP", "overlap"))])


def tile_names(files: DataFrame) -> DataFrame:
    """(zi, xi) of file names (path) like 3_12.h5, in order; other names are left out."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.regexp_extract(name, r"^(\d+)_(\d+)\.\w+$", 1).try_cast("int").alias("zi"), F.regexp_extract(name, r"^(\d+)_(\d+)\.\w+$", 2).try_cast("int").alias("xi")).where("zi is not null and xi is not null").orderBy("zi", "xi")


_scratch: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, from spark.checkpoint.dir; a local one only where Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _scratch:
            _scratch.append("file://" + tempfile.mkdtemp(prefix="lamina-"))
        at = _scratch[0]
    return f"{at.rstrip('/')}/lamina/{uuid.uuid4().hex}"
