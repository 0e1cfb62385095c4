"""Hard negatives by a space-filling order and zone maps.

Rows are sorted along a Hilbert curve through the leading directions of a sample and written as blocks of neighbours: a Parquet
row each, with its ids, labels and vectors, and its zone map, the least and greatest value of every dimension. Interval
arithmetic on a zone map bounds the inner products that a block can have with an anchor from both sides. A block has to be
read for an anchor only where these bounds meet a window of scores that still matters: for positives from the fifth best
score known so far upwards, for negatives each positive's window cut off below by the fifth best known in it.

What is known at first comes from the anchor's own block. Anchors come in batches of bounded size, in the curve's order, which
are broadcast: a first job reads zone maps alone and gives (block, anchors that must read it), a second one reads those blocks.
Bounds and scores are whole numbers, so results are exact for any data; only how many blocks are read depends on the curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, saved, table

#: Rows of a block and what a component is multiplied by.
BLOCK, SCALE = 128, 256
#: Rows that the curve's directions are fitted to; directions, and bits of each.
SAMPLE, AXES, BITS = 10_000, 9, 7
#: Positives of an anchor, negatives of a positive, and a window's lower end as hundredths of the positive's score.
POSITIVES, NEGATIVES, LOWEST = 5, 5, 80
#: Bytes of the anchors' vectors of a batch; rows of (block, anchors) that are broadcast, and anchors named in them, at most.
BATCH, ASKED, NAMED = 8 << 20, 50_000, 4_000_000
#: Zone maps that are held against a batch's anchors at once.
ZONES = 256
#: No score is less.
NONE = -(1 << 62)


def hilbert(at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of points (rows of whole numbers below 2 ** bits), by turning each bit's cube into the curve's frame."""
    x = at.T.astype(np.int64).copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for k in range(n):
            high = (x[k] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(high, below, swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            place = (place << 1) | ((x[k] >> bit) & 1)
    return place


class Curve:
    """The curve through the leading directions of sample vectors, each cut into ranges with as many of them."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        _, _, axes = np.linalg.svd(sample - self.mean, full_matrices=False)
        self.axes = axes[:AXES].T
        places = np.sort((sample - self.mean) @ self.axes, axis=0)
        self.cuts = places[np.arange(1, 1 << BITS) * len(places) >> BITS] if len(places) else np.zeros((0, self.axes.shape[1]))

    def places(self, vectors: np.ndarray) -> np.ndarray:
        if not self.axes.size:
            return np.zeros(len(vectors), np.int64)
        on = (vectors - self.mean) @ self.axes
        return hilbert(np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts.T, on.T, strict=True)], axis=1))


def packed(m: np.ndarray) -> bytes:
    """A matrix of whole numbers in as few bytes as hold them, after their size."""
    most = int(np.abs(m).max()) if m.size else 0
    size = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([size]) + m.astype(f"<i{size}").tobytes()


def unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(rows, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in double precision where no sum can pass 2 ** 53."""
    big = (lambda m: float(np.abs(m.astype(float)).max()) if m.size else 0.0)
    if big(a) * big(b) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest inner products that (vectors x zones) can have, by interval arithmetic."""
    plus, minus = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return products(plus, low) + products(minus, high), products(plus, high) + products(minus, low)


ROW = "vec_id long, label long, dims int, place long, vector binary"
FILED = "block long, dims int, n int, low binary, high binary, least long, labels array<long>, ids binary, own binary, vectors binary"
ANCHOR = "block long, dims int, anchor_id long, label long, vector binary, floor long, floor_id long, near binary"
WANTED = "block long, anchors binary"


def taking_part(rows: DataFrame, id_col: str, label_col: str, vector_col: str, relabel=None) -> DataFrame:
    """(vec_id, label, vector) of rows with all three, whose components are finite and small enough for scores to be longs."""
    label = F.col(label_col).cast("long")
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    if relabel is not None:
        own = own.withColumn("label", relabel)
    most = F.lit(float(isqrt((1 << 62) // 100)) / SCALE) / F.sqrt(F.greatest(F.size("vector"), F.lit(1)))
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(fits)


def scaled(vectors: list) -> np.ndarray:
    return np.floor(SCALE * np.array(vectors, float)).astype(np.int64)


def filed(rows: DataFrame) -> DataFrame:
    """The written blocks of (vec_id, label, vector)."""
    spark = rows.sparkSession
    sample: dict[int, list] = {}
    for r in bounded_sample(rows, SAMPLE, "vec_id").select("vector").limit(2 * SAMPLE).collect():  # bounded; only the order depends on it
        sample.setdefault(len(r.vector), []).append(r.vector)
    curves = spark.sparkContext.broadcast({n: Curve(np.array(v, float).reshape(len(v), n)) for n, v in sample.items()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.to_pydict().values()
            lengths = np.fromiter(map(len, vectors), int, len(vectors))
            for n in np.unique(lengths):
                which = np.flatnonzero(lengths == n)
                some = np.array([vectors[k] for k in which], float).reshape(len(which), n)
                at = curves.value[n].places(some) if n in curves.value else np.zeros(len(which), np.int64)
                whole = np.floor(SCALE * some).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array([ids[k] for k in which], pa.int64()), "label": pa.array([labels[k] for k in which], pa.int64()), "dims": pa.array([n] * len(which), pa.int32()), "place": at, "vector": [packed(v[None]) for v in whole]})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 40
        held: list[dict] = []
        for row in (r for batch in batches for r in batch.to_pylist()):
            if held and (len(held) == BLOCK or row["dims"] != held[0]["dims"]):
                yield block_of(held, made)
                made, held = made + 1, []
            held.append(row)
        if held:
            yield block_of(held, made)

    order = ("dims", "place", "vec_id", "label")
    ordered = rows.mapInArrow(placed, ROW).repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ordered.mapInArrow(blocks, FILED), "blocks")


def block_of(rows: list[dict], number: int) -> pa.RecordBatch:
    rows = sorted(rows, key=lambda r: r["vec_id"])  # so that of equal scores the first comes first
    n, dims = len(rows), rows[0]["dims"]
    m = np.concatenate([unpacked(r["vector"], 1).astype(np.int64) for r in rows])
    ids, labels = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64)
    columns = {"block": [number], "dims": pa.array([dims], pa.int32()), "n": pa.array([n], pa.int32()), "low": [packed(m.min(0)[None])], "high": [packed(m.max(0)[None])], "least": [int(ids[0])], "labels": [np.unique(labels).tolist()], "ids": [ids.tobytes()], "own": [labels.tobytes()], "vectors": [packed(m)]}
    return pa.RecordBatch.from_pydict(columns)


def _content(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, labels and vectors."""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int64), unpacked(row["vectors"], row["n"])


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first by (score descending, id), ids ascending."""
    if len(scores) > 4 * most:
        some = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
        return some[np.lexsort((ids[some], -scores[some]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """The anchors, in the curve's order, with what their own blocks tell: the fifth best positive known (floor and its id), and
    scores with rows of other labels there (near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, m = _content(row)
                who = np.flatnonzero(ids % every == 0)
                scores = products(m[who], m)
                out: list[tuple] = []
                for k, s in zip(who, scores, strict=True):
                    same, other = (labels == labels[k]) & (ids != ids[k]), labels != labels[k]
                    top = best(s[same], ids[same], POSITIVES)
                    full = len(top) == POSITIVES
                    out.append((row["block"], row["dims"], int(ids[k]), int(labels[k]), packed(m[k][None]), int(s[same][top[-1]]) if full else NONE, int(ids[same][top[-1]]) if full else 0, np.sort(s[other])[::-1].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[x.split()[0] for x in ANCHOR.split(", ")])

    return blocks.select("block", "dims", "n", "ids", "own", "vectors").mapInArrow(run, ANCHOR)


class Batch:
    """Anchors of one length, as arrays: what is broadcast."""

    def __init__(self, rows: list, windows: np.ndarray | None = None):
        self.number = np.array([r.number for r in rows], np.int64)
        self.ids, self.labels = np.array([r.anchor_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64)
        self.vectors = np.concatenate([unpacked(r.vector, 1).astype(np.int64) for r in rows])
        self.floor, self.floor_id = np.array([r.floor for r in rows], np.int64), np.array([r.floor_id for r in rows], np.int64)
        self.dims = self.vectors.shape[1]

    def windowed(self, positives: list[list[int]], near: list[bytes]) -> Batch:
        """With windows (anchor x positive): lower and upper ends; the lower one as what is known allows. Empty ones end below their start."""
        shape = (len(self.ids), POSITIVES)
        self.low, self.high = np.full(shape, 1, np.int64), np.zeros(shape, np.int64)
        for k, (scores, known) in enumerate(zip(positives, near, strict=True)):
            seen = np.frombuffer(known, np.int64)  # descending
            for j, p in enumerate(scores):
                least = -(-LOWEST * p // 100)
                within = seen[(seen <= p) & (seen >= least)]
                self.low[k, j], self.high[k, j] = int(within[NEGATIVES - 1]) if len(within) >= NEGATIVES else least, p
        return self


def wanted(blocks: DataFrame, shared, positives: bool) -> DataFrame:
    """(block, anchors): which anchors of the batch must read which blocks, by zone maps alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: Batch = shared.value
        for rows in (part.to_pylist() for batch in batches for part in (batch.slice(k, ZONES) for k in range(0, batch.num_rows, ZONES))):
            rows = [r for r in rows if r["dims"] == some.dims]
            if not rows:
                continue
            low, high = (np.concatenate([unpacked(r[c], 1) for r in rows]) for c in ("low", "high"))
            least, most = bounds(some.vectors, low, high)
            for k, r in enumerate(rows):
                labels = np.array(r["labels"], np.int64)
                if positives:
                    first = (most[:, k] > some.floor) | ((most[:, k] == some.floor) & (r["least"] <= some.floor_id))
                    must = np.isin(some.labels, labels) & first
                else:
                    meets = (most[:, k, None] >= some.low) & (least[:, k, None] <= some.high) & (some.low <= some.high)
                    must = meets.any(1) & ((len(labels) > 1) | (some.labels != labels[0]))
                who = np.flatnonzero(must).astype("<i4")
                if len(who):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int64()), "anchors": [who.tobytes()]})

    return blocks.select("block", "dims", "low", "high", "least", "labels").mapInArrow(run, WANTED)


def read(blocks: DataFrame, asked: DataFrame, shared, positives: bool) -> DataFrame:
    """(number, window, score, vec_id): the first rows of each block that is asked for, for each anchor's windows; positives have one window."""
    size = asked.agg(F.count("*"), F.sum(F.octet_length("anchors")), F.min("block"), F.max("block")).first()
    few = size[0] <= ASKED and (size[1] or 0) <= 4 * NAMED
    # Blocks of one batch lie near each other on the curve: Parquet skips the others by their numbers.
    part = blocks.where(F.col("block").between(size[2] or 0, size[3] or 0)).select("block", "n", "ids", "own", "vectors")
    met = part.join(F.broadcast(asked) if few else asked, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: Batch = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, m = _content(row)
                who = np.frombuffer(row["anchors"], "<i4")
                out: list[tuple[np.ndarray, ...]] = []
                for part in np.array_split(who, len(who) // 1024 + 1):
                    scores = products(some.vectors[part], m)
                    for k, s in zip(part, scores, strict=True):
                        for j in range(1 if positives else POSITIVES):
                            if positives:
                                fit = (labels == some.labels[k]) & (ids != some.ids[k]) & ((s > some.floor[k]) | ((s == some.floor[k]) & (ids <= some.floor_id[k])))
                            else:
                                fit = (labels != some.labels[k]) & (s >= some.low[k, j]) & (s <= some.high[k, j])
                            at = np.flatnonzero(fit)
                            if len(at):
                                at = at[best(s[at], ids[at], POSITIVES if positives else NEGATIVES)]
                                out.append((np.full(len(at), some.number[k]), np.full(len(at), j), s[at], ids[at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["number", "window", "score", "vec_id"])

    return met.mapInArrow(run, "number long, window long, score long, vec_id long")


def first(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` first rows of each window; Spark leaves out what can't be among them before it shuffles."""
    by = Window.partitionBy("number", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, every: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", relabel=None) -> DataFrame:
    """Per anchor (a row whose id ``every`` divides), positive and negative: their ids, rank, and scores.

    Rows without an id, label or vector, or with a component that is null, not finite, or so large that scores might not be
    longs, take no part; vectors of different lengths have no score with each other. A row with the anchor's id isn't its
    candidate; rows that share an id are a candidate, and an anchor, each. Ties go to smaller ids. Other columns are left out,
    so none can clash; an empty table gives an empty result. ``relabel`` is a column of vec_id and label that replaces label.
    """
    spark = rows.sparkSession
    blocks = filed(taking_part(rows, id_col, label_col, vector_col, relabel))
    anchors = saved(anchors_of(blocks, every).withColumn("number", F.monotonically_increasing_id()), "anchors")
    results = []
    for batch in batches_of(anchors):
        shared = spark.sparkContext.broadcast(Batch(batch))
        asked = saved(wanted(blocks, shared, True), "asked")
        positives = saved(first(read(blocks, asked, shared, True), POSITIVES).select("number", F.col("rank").alias("window"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "positives")
        scores: dict[int, list[int]] = {r.number: [] for r in batch}
        for r in positives.orderBy("number", "window").collect():  # five for each anchor of the batch
            scores[r.number].append(r.positive_score)
        shared = spark.sparkContext.broadcast(Batch(batch).windowed([scores[r.number] for r in batch], [r.near for r in batch]))
        asked = saved(wanted(blocks, shared, False), "asked")
        negatives = first(read(blocks, asked, shared, False), NEGATIVES).select("number", (F.col("window") + 1).alias("window"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = positives.join(negatives, ["number", "window"]).join(anchors.select("number", "anchor_id"), "number")
        results.append(saved(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, results)


def batches_of(anchors: DataFrame) -> Iterator[list]:
    """Anchors of one length at a time, in the curve's order, with at most BATCH bytes of vectors."""
    for sizes in anchors.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():  # lengths of vectors
        each = max(1, BATCH // (8 * max(1, sizes.dims) + 8 * BLOCK))
        some = anchors.where(F.col("dims") == sizes.dims)
        parts = -(-sizes.n // each)
        if parts == 1:
            yield some.orderBy("number").collect()
            continue
        cuts = some.stat.approxQuantile("number", [k / parts for k in range(1, parts)], 0.1 / parts)
        edges = [None, *sorted(set(cuts)), None]
        for low, high in zip(edges, edges[1:], strict=False):
            part = some if low is None else some.where(F.col("number") > low)
            rows = (part if high is None else part.where(F.col("number") <= high)).orderBy("number").collect()
            if rows:
                yield rows


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hard_negatives() of the embeddings' anchors; where 7 divides vec_id, the label is the next one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), relabel=label)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, CASE WHEN len(e.v) = 0 THEN 0 ELSE list_inner_product(a.v, e.v) END::BIGINT AS score FROM a JOIN e ON a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""
