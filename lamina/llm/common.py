"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows and bytes of one Arrow batch at most: some thousand texts of a few kB, or fewer long ones, stay well below a Python
#: worker's share of memory.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts takes in a Python worker. These are settings of the session, and stay so: Spark
    reads them when a lazy result is at last computed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Applies fn, which gives columns by name, to each Arrow batch of df; a map without a shuffle."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filtered_batches(df: DataFrame, fn: Callable[[list], list[bool]], column: str) -> DataFrame:
    """The rows of df, with all their columns, for which fn is true; it is given the values of a column. A map without a shuffle."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(fn(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a local one only where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local_shared()
    return at.rstrip("/")


_own: list[str] = []


def _local_shared() -> str:
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lamina-shared-"))
    return _own[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: cuts its lineage, so that a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)  # what a task buffers
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more rows than this aren't joined by a shuffle (or with a larger number, that so many have as are broadcast).
HOT_ROWS = 1000


def by_key(rows: DataFrame, one: DataFrame, keys: list[str], few: int) -> DataFrame:
    """rows inner joined with one, which has a row for each key, with ``copies``, how many of rows have it. one is broadcast if
    it has at most ``few`` rows; else what is shuffled leaves out keys with very many rows, whose part of one is broadcast: of
    such there are at most ``few``."""
    if one.count() <= few:
        return rows.join(F.broadcast(one.drop("copies")), keys)
    hot = max(HOT_ROWS, one.agg(F.sum("copies")).first()[0] // few)
    large, small = one.where(F.col("copies") > hot).drop("copies"), one.where(F.col("copies") <= hot).drop("copies")
    return rows.join(F.broadcast(large), keys).unionByName(rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys))


def given_back() -> None:
    """What numpy and Arrow have freed goes back to the system: workers stay alive between tasks, beside the JVM and each other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4: rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class BoundedCache(dict):
    """Values by key, computed on a miss. When full, the younger half goes: what came first came because it is frequent.
    Keys longer than ``longest`` aren't kept, so that a few very long words can't fill a worker's memory.

    A worker that goes on with another operator's tasks gives up the caches and models of the one before: see ``working_on``.
    """

    #: The operator that this worker works on, the caches that are in use, and dictionaries of models that were given to it.
    owner, alive = "", weakref.WeakSet()
    models: list[dict] = []

    def __init__(self, compute: Callable, limit: int, longest: int = 128):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        BoundedCache.alive.add(self)

    __hash__ = object.__hash__

    @staticmethod
    def working_on(owner: str) -> None:
        if BoundedCache.owner != owner:
            for held in (*BoundedCache.models, *BoundedCache.alive):
                held.clear()
            gc.collect()
            given_back()
            BoundedCache.owner = owner

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > self.longest:
            return self.compute(key)
        if len(self) >= self.limit:
            for k in list(self)[self.limit // 2 :]:
                del self[k]
        value = self[key] = self.compute(key)
        return value


def bounded_sample(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """About ``most`` of the rows, chosen by a hash of their id: all of them where there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))
