"""Best-fit packing in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so documents and gaps of one size are the same to a best fit. Both are
therefore kept sorted by size as runs: (size, first rank or sequence, how many). A round is a Spark job over the runs, dealt
to tasks by ranges of sizes. In each range a sweep goes from the largest document down, with the gaps that are large enough
on a stack, the smallest on top: a run takes its successors from the top, the r-th documents the r-th gap of a run, which
settles every conflict by rank. What is left of all ranges, documents that need a gap of a higher one and gaps that no
document of their own took, is swept together, which gives what one sweep over all would. Gaps are updated when the round
ends, and the next one begins; where nothing fits any more, the largest documents open sequences, most of those that what is
left needs at least. The number of rounds and of runs depends on the sizes, not on the number of documents: some dozens, and
some thousands. Spark counts the documents by size, ranks them within their size in salted groups, and places each one by its
rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import BoundedCache, saved, small_batches, table

CAPACITY = 2048
#: Documents of one length are dealt into groups of about so many to be ranked, so no task sorts more.
RANKED = 10_000
#: Groups whose offsets are broadcast at most; beyond, the join is a shuffled one.
BROADCAST = 1_000_000
WORD_LIMIT = 300_000
#: Ranges of sizes that a round's runs are dealt into; the share of the sequences that what is left needs at least which is
#: opened when nothing fits.
RANGES, OPENED = 8, 0.9


class Ids:
    """Ids of whole texts as the tokenizer file gives them, with special strings handled as its default, as little-endian 32-bit integers."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("same ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        self.words = BoundedCache(self._word, WORD_LIMIT)

    def _text(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _word(self, word: str) -> bytes | None:
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        ids = self.fast.encode_ordinary(" " + word)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        first, *words = text.split(" ")
        if first and not first[-1].isspace():  # a single space between two other characters always starts a pre-token
            try:
                return b"".join((self._text(first), *map(self.words.__getitem__, words)))
            except TypeError:  # white space beside a space: _word gave None
                pass
        return self._text(text)


@lru_cache(maxsize=1)
def _ids(json_path: str, ranks_path: str, pattern: str) -> Ids:
    return Ids(json_path, ranks_path, pattern)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of a document's ids (its text's, then id 0): doc_id, piece, start, length, ids_crc32. A null text counts as empty."""
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            BoundedCache.working_on(__name__)
            coder = _ids(*files)
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = coder.of(text or "") + bytes(4)
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start - 1) % capacity + 1 if not piece else capacity
                    for column, x in zip(rows, (doc_id, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES)


Run = tuple[int, int, int, int]  # DOCUMENTS or GAPS, size, first rank or sequence, how many
Placed = tuple[int, int, int, int, int, int]  # size, first rank, documents in each gap, gap, first sequence, gaps
DOCUMENTS, GAPS, PLACED = 0, 1, 2
ROUND = "kind long, size long, first long, n long, each long, gap long, sequence long"
FIELDS = tuple(x.split()[0] for x in ROUND.split(", "))


def sweep(runs: list[Run]) -> tuple[list[Placed], list[Run]]:
    """Best fit within some runs: what is placed, and what is left. A gap takes as many documents of a run as it can: after
    each, its rest is still the smallest gap for the next."""
    documents = sorted((r[1:] for r in runs if r[0] == DOCUMENTS), reverse=True)
    waiting = sorted(r[1:] for r in runs if r[0] == GAPS)
    stack: list[tuple[int, int, int]] = []
    placed: list[Placed] = []
    left: list[Run] = []
    for size, first, n in documents:
        while waiting and waiting[-1][0] >= size:
            stack.append(waiting.pop())
        while stack and n:
            gap, sequence, gaps = stack.pop()
            each = min(n, gap // size)
            taken = min(gaps, n // each)
            placed.append((size, first, each, gap, sequence, taken))
            first, n = first + each * taken, n - each * taken
            if taken < gaps:
                stack.append((gap, sequence + taken, gaps - taken))
        if n:
            left.append((DOCUMENTS, size, first, n))
    return placed, left + [(GAPS, *g) for g in (*waiting, *stack)]


def swept(spark: SparkSession, runs: list[Run]) -> tuple[list[Placed], list[Run]]:
    """sweep() as a Spark job: in ranges of sizes, then of what they leave. Runs are bounded, so they come from the driver and go back."""

    def one(group: pa.Table) -> pa.Table:
        rows = list(zip(*(c.to_pylist() for c in group.select(FIELDS).columns), strict=True))
        placed, left = sweep([r[:4] for r in rows if r[0] != PLACED])
        done = [r for r in rows if r[0] == PLACED]
        return _table(done + [(PLACED, size, first, gaps, each, gap, sequence) for size, first, each, gap, sequence, gaps in placed] + [(*r, 0, 0, 0) for r in left])

    sizes = sorted(r[1] for r in runs)
    borders = sorted({sizes[len(sizes) * k // RANGES] for k in range(1, RANGES)})  # ranges with about as many runs each
    of = sum(((F.col("size") >= b).cast("int") for b in borders), F.lit(0))
    ranges = spark.createDataFrame(_table([(*r, 0, 0, 0) for r in runs])).groupBy(of.alias("range")).applyInArrow(one, ROUND)
    out = ranges.groupBy(F.lit("all").alias("every")).applyInArrow(one, ROUND).toArrow()
    found = list(zip(*(c.to_pylist() for c in out.columns), strict=True))
    return [(size, first, each, gap, sequence, n) for kind, size, first, n, each, gap, sequence in found if kind == PLACED], [r[:4] for r in found if r[0] != PLACED]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(FIELDS))], names=FIELDS)


def plan(counts: dict[int, int], capacity: int = CAPACITY, sweeper: Callable[[list[Run]], tuple[list[Placed], list[Run]]] = sweep) -> list[Placed]:
    """Where documents go, from how many have each length. A round is a call of sweeper."""
    left = {n: (0, c) for n, c in counts.items() if c > 0}  # first rank, how many
    placed: list[Placed] = []
    gaps: list[Run] = []
    opened = 0

    def open_for(length: int, most: int) -> int:
        nonlocal opened
        first, n = left.pop(length)
        taken = min(n, most)
        placed.append((length, first, 1, capacity, opened, taken))
        gaps.append((GAPS, capacity - length, opened, taken))
        opened += taken
        if taken < n:
            left[length] = (first + taken, n - taken)
        return taken

    for length in sorted((x for x in left if 2 * x > capacity), reverse=True):
        open_for(length, left[length][1])
    while left:
        smallest = min(left)
        gaps = [g for g in gaps if g[1] >= smallest]
        done, rest = sweeper([(DOCUMENTS, size, first, n) for size, (first, n) in left.items()] + gaps) if gaps else ([], [])
        if done:
            placed += done
            left = {size: (first, n) for kind, size, first, n in rest if kind == DOCUMENTS}
            gaps = [r for r in rest if r[0] == GAPS] + [(GAPS, gap - each * size, sequence, n) for size, _, each, gap, sequence, n in done]
        else:
            most = max(1, int(OPENED * sum(size * n for size, (_, n) in left.items()) / capacity))
            for length in sorted(left, reverse=True):
                if most:
                    most -= open_for(length, most)
    return placed


def pack(items: DataFrame, capacity: int = CAPACITY, ranked_at_once: int = RANKED) -> DataFrame:
    """Adds sequence_id and offset to items (doc_id, piece, length, ...), lengths from 1 to capacity.

    Sequences are filled from offset 0 without gaps and never beyond the capacity. Rows that repeat are placed each by
    itself. items is read several times and must give the same rows each time, as a written table does; a column ``_row`` that
    tells its rows apart, if there is one, spreads even equal rows over groups, and is left out of the result.
    """
    spark = items.sparkSession
    total = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(total, capacity, lambda some: swept(spark, some))
    # A length has as many groups as its documents need.
    groups = spark.createDataFrame([(length, -(-n // ranked_at_once)) for length, n in total.items()], "length long, _groups long")
    by = [c for c in ("doc_id", "piece", "start", "_row") if c in items.columns]
    salted = items.join(F.broadcast(groups), "length").withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_groups")))
    counts = saved(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "groups")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_first"))
    few = counts.count() <= BROADCAST
    places = spark.createDataFrame([(size, a, a + each * n, each, gap, sequence) for size, a, each, gap, sequence, n in runs], "length long, _from long, _to long, _each long, _gap long, _sequence long")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*by)) - 1)
        .join(F.broadcast(offsets) if few else offsets, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_first"))
    )
    # A length's runs are few, and all runs are bounded by rounds and sizes, not by documents.
    at = F.col("_rank") - F.col("_from")
    return (
        ranked.join(F.broadcast(places), (ranked.length == places.length) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumns({"sequence_id": F.col("_sequence") + F.floor(at / F.col("_each")), "offset": F.lit(capacity) - F.col("_gap") + (at % F.col("_each")) * ranked.length})
        .select(*(ranked[c] for c in items.columns if c != "_row"), "sequence_id", "offset")
    )


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: one piece, of id 0 alone. Rows that repeat, or have no doc_id, are packed each by itself; which
    of equally long pieces goes where is decided by doc_id, piece and start. Other columns are left out, so none can clash; an
    empty table gives an empty one. Texts are encoded whole, of any length.
    """
    small_batches(docs.sparkSession)
    return pack(saved(pieces(docs, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packed() of all documents."""
    return packed(table(spark, sf_dir, "documents"))
