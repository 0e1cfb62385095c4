"""N-gram Jaccard join by vertical partitioning, and near-duplicate groups.

Texts with equal sets of n-grams are one class, of which the document with the smallest id stands for all. In a global order
of n-grams, rare ones first, two similar sets share one of the first few: each set's prefix. Documents that share a prefix
n-gram, near enough in size and position to be similar at all, meet under a key: the n-gram's first document.

What meets is counted by vertical partitioning. The global order is cut into fragments, and each set with it into segments. A
segment goes to the task of its key and fragment, where its overlap with others is counted: a partial count of the pair. The
sums per pair decide. So that a group of many near copies doesn't become all its pairs, first only the pairs of each document
with one pivot are counted, in rounds while these settle much. Similarity is a metric: what is linked to a pivot needs no pair
among itself, and what is far from it only what is as far. The pairs that are left are counted in tiles; a fragment leaves out
those that can't be similar even if they agree in all other fragments. Links become components in rounds of star contractions
over written tables.

The order only needs to be the same for all; it puts an n-gram last that some task saw often, so that a passage which many
documents share isn't in their prefixes unless they consist of it. Documents with such an n-gram in their prefix meet under
its key without a shuffle of that n-gram, so no task gets all rows of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, by_key, given_back, saved, table

N, PERCENT = 5, 75
#: An n-gram that so many sets within one block of a task have is put last; a block holds about so many n-grams.
FREQUENT, BLOCK = 4, 4_000_000
#: Frequent n-grams that are broadcast at most (24 bytes each), those seen most; others keep their place by hash, which
#: only makes their lists longer.
ORDERED = 2_000_000
#: Of the documents with one n-gram, pairs are made and their common n-grams counted where there are so many at most; of
#: more, all meet under the n-gram.
PAIRED = 256
#: Fragments of the global order: its rare n-grams by hash into all but one, the frequent ones.
FRAGMENTS = 4
#: Documents of a block, which meet a pivot, or another block in a tile, in one task; columns of its matrices at once.
TILE, COLUMNS = 1024, 2048
#: Rounds of pivots go on while one leaves less than this share of the members.
SETTLED = 0.5
#: Rows are broadcast up to so many; beyond, the join is a shuffled one, but for keys with very many rows.
BROADCAST_IDS = 2_000_000
#: Bytes of sets that leave a task at once.
BATCH_BYTES = 8 << 20
#: N-grams of a block that are looked up at once.
LOOKED_UP = 1 << 18
KEPT = 250_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@lru_cache(maxsize=1)
def _word_hashes() -> BoundedCache:
    return BoundedCache(lambda word: blake2b(word, digest_size=8).digest(), KEPT)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The set of 64-bit hashes of n words in a row, ascending. Words: runs of anything but ASCII white space, A-Z lower-cased.
    With fewer words the whole sequence is one; without a word the set is empty."""
    BoundedCache.working_on(__name__)
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.frombuffer(b"".join(map(_word_hashes().__getitem__, words)), "<u8")
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = _mixed(total + hashed[i : len(words) - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(total)


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest overlap of similar sets with a and b members: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many of n members, first in order, must hold one in common with any similar set."""
    return n - -(-percent * n // 100) + 1


def often_seen(grams: list[np.ndarray], owners: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets, whose ids and sizes owners has: for each n-gram that FREQUENT or more have the smallest id among them, the n-gram,
    and how many have it. All n-grams are held twice, and what is found of them LOOKED_UP at once."""
    every = np.concatenate(grams)
    found = np.sort(every)
    often = np.unique(found[FREQUENT - 1 :][found[FREQUENT - 1 :] == found[: len(found) - FREQUENT + 1]])  # sets have an n-gram once
    del found
    least, seen = np.full(len(often), np.iinfo(np.int64).max), np.zeros(len(often), np.int64)
    ends, ids = np.cumsum([k for _, k in owners]), np.array([i for i, _ in owners], np.int64)
    for start in range(0, len(every) if len(often) else 0, LOOKED_UP):
        some = every[start : start + LOOKED_UP]
        at = np.minimum(np.searchsorted(often, some), len(often) - 1)
        has = np.flatnonzero(often[at] == some)
        at = at[has]
        np.minimum.at(least, at, ids[np.searchsorted(ends, start + has, "right")])
        np.add.at(seen, at, 1)
    return least, often, seen


SETS = "doc_id long, n long, high long, low long, grams binary, gram long, seen long"


def described(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n (size of its set), high and low (a 128-bit digest of it), grams (its members, ascending); and per
    block of a task the n-grams that FREQUENT or more of its different sets have: gram, seen, and in doc_id the smallest id
    among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "high", "low", "grams", "gram", "seen"]
        grams: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        known: set[bytes] = set()
        held = 0

        def frequent() -> Iterator[pa.RecordBatch]:
            nonlocal grams, owners, known, held
            if grams:
                least, often, seen = often_seen(grams, owners)
                grams = []
                none = pa.nulls(len(often), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(least), none, none, none, pa.nulls(len(often), pa.binary()), pa.array(often.view(np.int64)), pa.array(seen)], names=names)
            grams, owners, known, held = [], [], set(), 0
            given_back()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), pa.array([r[4] for r in rows], pa.binary()), none, none], names=names)

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(text)
                data = found.tobytes()
                digest = blake2b(data, digest_size=16).digest()
                rows.append((doc_id, len(found), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), data))
                size += len(data)
                if size > BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
                if len(found) and doc_id is not None and digest not in known:
                    known.add(digest)
                    grams.append(found)
                    owners.append((doc_id, len(found)))
                    held += len(found)
            yield made(rows)
            if held > BLOCK:
                yield from frequent()
        yield from frequent()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SETS)


def global_order(found: DataFrame, most: int = ORDERED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent n-grams, ascending, with their rank in the order and their key; at most ``most``."""
    rows = found.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen"), F.min("doc_id").alias("key")).orderBy(F.desc("seen"), "gram").limit(most)
    t = rows.toArrow()  # bounded by most
    grams, seen, keys = (t.column(c).to_numpy() for c in ("gram", "seen", "key"))
    grams = grams.astype(np.int64).view(np.uint64)
    ranks = np.empty(len(grams), np.int64)
    ranks[np.lexsort((grams, seen))] = np.arange(1, len(grams) + 1)
    order = grams.argsort()
    return grams[order], ranks[order], keys[order].astype(np.int64)


def in_order(found: np.ndarray, order: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, and for each member the place of its n-gram among the frequent ones, -1 for none."""
    frequent, ranks, _ = order
    if not len(frequent):
        return found, np.full(len(found), -1)
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    at = np.where(frequent[at] == found, at, -1)
    sort = np.argsort(np.where(at >= 0, ranks[at], 0), kind="stable")
    return found[sort], at[sort]


def members(sets: DataFrame, shared: Broadcast) -> DataFrame:
    """(doc_id, key): documents that can be similar to another one meet under a key. sets has (doc_id, grams), shared the
    global order.

    Similar sets share not just one n-gram of their prefixes but many: of each at most as many are not in the other as its
    size exceeds the least overlap. So a pair that shares too few goes, which leaves out chance matches.
    """
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, n, frequent, doc_id) for each rare n-gram of a prefix, n being the size of the set and frequent how many
        others the prefix has; for those with a key, (key, -1, 0, doc_id)."""
        for batch in batches:
            parts: list[tuple] = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(data, "<u8")
                n = len(found)
                if not n:
                    continue
                p = prefix_length(n)
                grams, at = in_order(found, shared.value)
                rare, at = grams[:p][at[:p] < 0], at[:p][at[:p] >= 0]
                keys = np.unique(shared.value[2][at])
                parts.append((np.concatenate((rare.view(np.int64), keys)), np.concatenate((np.full(len(rare), n, np.int32), np.full(len(keys), -1, np.int32))), len(at), doc_id))
            if parts:
                sizes = [len(x[0]) for x in parts]
                columns = [np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), np.repeat(np.array([x[2] for x in parts], np.int32), sizes), np.repeat(np.array([x[3] for x in parts], np.int64), sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "n", "frequent", "doc_id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows by n-gram, then document: (a, b, need) for a pair that needs so many common n-grams; need -1 for a
        document a that meets others under the key b."""
        left: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last n-gram may go on in the next batch
            yield met([x[:cut] for x in now])
            left = [x[cut:] for x in now]
        if left is not None:
            yield met(left)
        given_back()

    def met(rows: list[np.ndarray]) -> pa.RecordBatch:
        out: list[tuple] = []
        keyed = rows[1] < 0
        out.append((rows[3][keyed], rows[0][keyed], np.full(int(keyed.sum()), -1)))
        grams, sizes, frequent, ids = (x[~keyed] for x in rows)
        if len(grams):
            starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            counts = np.diff(np.append(starts, len(grams)))
            firsts, seconds = [starts[counts == 2]], [starts[counts == 2] + 1]
            for start, count in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
                if count <= PAIRED:
                    i, j = np.triu_indices(count, 1)
                    firsts.append(start + i)
                    seconds.append(start + j)
                else:
                    run = ids[start : start + count]
                    out.append((run, np.full(count, run[0]), np.full(count, -1)))
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            na, nb = sizes[a].astype(np.int64), sizes[b].astype(np.int64)
            overlap = least_overlap(na, nb)
            need = overlap + 1 - -(-PERCENT * np.maximum(na, nb) // 100) - np.minimum(frequent[a], frequent[b])
            good = (overlap <= np.minimum(na, nb)) & (ids[a] != ids[b])
            out.append((ids[a][good], ids[b][good], np.maximum(need, 1)[good]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["a", "b", "need"])

    made = sets.select("doc_id", "grams").mapInArrow(entries, "gram long, n int, frequent int, doc_id long")
    # A frequent n-gram's key isn't what its rows are dealt by: they meet later, under each key in tiles.
    dealt = made.repartition(F.when(F.col("n") < 0, F.col("doc_id")).otherwise(F.col("gram"))).sortWithinPartitions("gram", "doc_id")
    pairs = dealt.mapInArrow(meet, "a long, b long, need int").groupBy("a", "b", (F.col("need") < 0).alias("keyed")).agg(F.count("*").alias("common"), F.max("need").alias("need"))
    kept = saved(pairs.where("keyed or common >= need").select("a", "b", "keyed"), "pairs")
    under = kept.where("keyed").select(F.col("a").alias("doc_id"), F.col("b").alias("key"))
    # A pair needs no key of its own where both also meet the same smallest other document.
    single = kept.where("not keyed").select("a", "b")
    least = single.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"))
    with_a = single.join(least.select(F.col("node").alias("a"), F.col("m").alias("m_a")), "a", "left")
    with_b = with_a.join(least.select(F.col("node").alias("b"), F.col("m").alias("m_b")), "b")
    paired = with_b.where("m_a is null or m_a <> m_b").select(F.explode(F.array("a", "b")).alias("doc_id"), F.col("a").alias("key"))
    return under.union(paired).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap of each set on the left with each on the right."""
    counts = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    of_a, of_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(a, b)
    for at in range(0, len(shared), COLUMNS):
        some = shared[at : at + COLUMNS]
        sides = []
        for grams, of, n in ((a, of_a, len(left)), (b, of_b, len(right))):
            place = np.minimum(np.searchsorted(some, grams), len(some) - 1)
            has = some[place] == grams
            side = np.zeros((n, len(some)), np.float32)
            side[of[has], place[has]] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    return counts.astype(np.int64)


def segments(found: np.ndarray, order: tuple) -> list[np.ndarray]:
    """A set cut at the borders of the global order's fragments."""
    frequent = order[0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        last = frequent[at] == found
        found, often = found[~last], found[last]
    else:
        often = found[:0]
    borders = [np.uint64((k << 64) // (FRAGMENTS - 1)) for k in range(1, FRAGMENTS - 1)]
    return [*np.split(found, np.searchsorted(found, borders)), often]


#: What goes to a task for a place that a document has: as pivot (side 1, with the block of members that it meets) or not.
PLACES = "array<struct<key: long, i: int, j: int, side: int, label: long>>"
PARTIAL = "key long, a long, a_tag int, a_n int, b long, b_tag int, b_n int, common long"


def dealt(sets: DataFrame, places: DataFrame, shared: Broadcast) -> DataFrame:
    """A row for each segment of a set (doc_id, n, high, grams), in each place (key, i, j, side, label) of its document."""
    listed = saved(places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "i", "j", "side", "label")).alias("places")), "places")  # a document's own
    few = listed.count() <= BROADCAST_IDS
    here = sets.join(F.broadcast(listed) if few else listed, "doc_id").select("doc_id", F.col("n").cast("int").alias("n"), F.shiftright("high", 33).cast("int").alias("tag"), "grams", F.col("places").cast(PLACES).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "tag", "places", "fragment", "sizes", "grams"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), batches_type, pa.int32(), pa.list_(pa.int32()), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, n, tag, data, where in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                parts = segments(np.frombuffer(data, "<u8"), shared.value)
                sizes = [len(x) for x in parts]
                rows += [(doc_id, n, tag, where, f, sizes, x.tobytes()) for f, x in enumerate(parts) if len(x)]
                size += len(data)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    batches_type = pa.list_(pa.struct([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("label", pa.int64())]))
    made = here.mapInArrow(cut, f"doc_id long, n int, tag int, places {PLACES}, fragment int, sizes array<int>, grams binary")
    return made.withColumn("p", F.explode("places")).select("p.key", "p.i", "p.j", "fragment", "p.side", "p.label", "doc_id", "tag", "n", "sizes", "grams")


def _partial(group: pa.Table) -> pa.Table:
    """Partial counts of the pairs of some places in one fragment: of members with their pivot (i below 0), or of a tile's blocks."""
    key, i, j, fragment, sides, labels, ids, tags, n = (group.column(c).to_numpy() for c in ("key", "i", "j", "fragment", "side", "label", "doc_id", "tag", "n"))
    grams = [np.frombuffer(x, "<u8") for x in group.column("grams").to_pylist()]
    sizes = np.array(group.column("sizes").to_pylist())
    order = np.lexsort((tags, ids, sides, j, i, key))
    whole = np.stack([key[order], i[order], j[order], sides[order], ids[order], tags[order]], 1)
    new = np.concatenate(([True], (whole[1:] != whole[:-1]).any(1)))  # rows that repeat count once
    order, whole = order[new], whole[new]
    starts = np.flatnonzero(np.concatenate(([True], (whole[1:, :3] != whole[:-1, :3]).any(1))))
    out: list[tuple] = []
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        here = order[at:end]
        star, same = i[here[0]] < 0, i[here[0]] == j[here[0]]
        first, second = here[sides[here] == 0], here[sides[here] == (0 if same else 1)]
        if not len(first) or not len(second):
            continue
        counts = with_pivots([grams[x] for x in first], [grams[x] for x in second]) if star else overlaps([grams[x] for x in first], [grams[x] for x in second])
        keep = counts > 0
        if not star:
            # Together with all that the other fragments could give it must be enough; and what has one pivot is linked already.
            most = counts.copy()
            for f in range(sizes.shape[1]):
                if f != fragment[0]:
                    most += np.minimum(sizes[first, f][:, None], sizes[second, f][None, :])
            keep &= most >= least_overlap(n[first].astype(np.int64)[:, None], n[second].astype(np.int64)[None, :])
            keep &= (labels[first][:, None] != labels[second][None, :]) | (labels[first] == NO_LABEL)[:, None]
            keep &= (ids[first][:, None] != ids[second][None, :]) | (tags[first][:, None] != tags[second][None, :])
            if same:
                keep &= np.triu(np.ones(keep.shape, bool), 1)
        a, b = np.nonzero(keep)
        x, y = first[a], second[b]
        out.append((key[x], ids[x], tags[x], n[x], ids[y], tags[y], n[y], counts[a, b]))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 8
    given_back()
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "a", "a_tag", "a_n", "b", "b_tag", "b_n", "common"])


def with_pivots(members: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """overlaps() with few sets on the right."""
    every = np.concatenate(members)
    ends = np.cumsum([len(x) for x in members])
    out = np.zeros((len(members), len(pivots)), np.int64)
    for k, pivot in enumerate(pivots):
        has = np.concatenate(([0], np.cumsum(pivot[np.minimum(np.searchsorted(pivot, every), len(pivot) - 1)] == every)))
        out[:, k] = np.diff(has[np.concatenate(([0], ends))])
    return out


#: The label of a member that no pivot is linked to; ids themselves are labels otherwise.
NO_LABEL = -(1 << 63)


def counted(sets: DataFrame, places: DataFrame, shared: Broadcast) -> DataFrame:
    """(a, b, distance, linked) of the pairs that meet in places: partial counts by fragment, summed per pair. Places, each of two
    blocks at most, share tasks' groups: about a block's members in each."""
    groups = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, places.count() // TILE)))
    partial = dealt(sets, places, shared).groupBy(groups.alias("group"), "fragment").applyInArrow(_partial, PARTIAL)
    pairs = partial.groupBy("key", "a", "a_tag", "b", "b_tag").agg(F.sum("common").alias("o"), F.first("a_n").alias("x"), F.first("b_n").alias("y"))
    union = F.col("x") + F.col("y") - F.col("o")
    # Of different texts under one id the nearest decides.
    return pairs.groupBy("a", "b").agg(F.min(1 - F.col("o") / union).alias("distance"), F.max(100 * F.col("o") >= PERCENT * union).alias("linked"))


def links(sets: DataFrame, met: DataFrame, shared: Broadcast) -> DataFrame:
    """(a, b): similar documents among those that meet (doc_id, key), as few pairs as give the same components, and some more."""
    within = 1 - PERCENT / 100
    met_ids = met.select("doc_id").distinct()
    sets = saved(sets.join(F.broadcast(met_ids) if met.count() <= BROADCAST_IDS else met_ids, "doc_id", "left_semi").select("doc_id", "n", "high", "grams"), "met")
    open_ = met.withColumn("label", F.lit(NO_LABEL))
    found: list[DataFrame] = []
    before = None
    while True:
        groups = open_.groupBy("key").agg(F.count("*").alias("size"), F.min(F.when(F.col("label") == NO_LABEL, F.col("doc_id"))).alias("pivot")).where("size > 1")
        blocks = F.ceil(F.col("size") / TILE).cast("int")
        groups = saved(groups.select("key", "pivot", blocks.alias("blocks"), F.col("size").alias("copies")), "keys")
        placed = saved(by_key(open_, groups, ["key"], BROADCAST_IDS).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "members")
        size = placed.count()
        if not size:
            break
        if before is not None and size > SETTLED * before:
            # A block goes to the tiles with itself, with those before it (as the second side) and with those after it.
            tiles = placed.select("doc_id", "key", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            places = tiles.select("doc_id", "key", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
            found.append(saved(counted(sets, places, shared).where("linked").select("a", "b"), "links"))
            break
        before = size
        pivots = placed.where("doc_id = pivot").select("doc_id", "key", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).withColumns({"i": F.lit(-1), "side": F.lit(1)})
        others = placed.where("doc_id <> pivot").select("doc_id", "key", "label", F.col("block").alias("j"), F.lit(-1).alias("i"), F.lit(0).alias("side"))
        near = saved(counted(sets, others.unionByName(pivots), shared), "near")
        found.append(near.where("linked").select("a", "b"))
        # What isn't linked to the pivot may be to each other, or to what is, if that is as far from it but for the threshold.
        known = placed.where("doc_id <> pivot").join(near.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), "distance", "linked"), ["doc_id", "pivot"], "left")
        known = saved(known.select("doc_id", "key", "pivot", "label", F.coalesce("distance", F.lit(1.0)).alias("distance"), F.coalesce("linked", F.lit(False)).alias("linked")), "known")
        rest = saved(known.groupBy("key").agg(F.min(F.when(~F.col("linked"), F.col("distance"))).alias("least"), F.count("*").alias("copies")).where("least is not null"), "keys")
        label = F.when(F.col("linked"), F.coalesce(F.nullif("label", F.lit(NO_LABEL)), "pivot")).otherwise(F.col("label"))
        open_ = by_key(known, rest, ["key"], BROADCAST_IDS).where(f"not linked or distance >= least - {within} - 1e-9").select("doc_id", "key", label.alias("label"))
    none = sets.sparkSession.createDataFrame([], "a long, b long")
    for one in found:
        none = none.union(one)
    return none


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches, by large-star and small-star rounds."""
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies")).select("a", F.least("a", "m").alias("m"), "copies"), "least")
        large = by_key(both, least, ["a"], BROADCAST_IDS).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, "edges")
        least = saved(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies")), "least")
        small = by_key(large, least, ["a"], BROADCAST_IDS).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = saved(small, "edges")
        same = after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Null and empty texts have an empty set and link with nothing, not with each other either. Equal sets link. A row without
    a doc_id can't be named by another one: it links with nothing, and its component_id is null. Rows that repeat each have a
    row; different texts with one doc_id are one node. Other columns are left out, so none can clash; an empty table gives an
    empty result.
    """
    found = saved(described(docs), "sets")
    sets = found.where("gram is null and n > 0 and doc_id is not null").select("doc_id", "n", "high", "low", "grams")
    rows = found.where("gram is null").select("doc_id", F.col("n").alias("n_shingles"), "high", "low")
    classes = saved(sets.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    copies = saved(by_key(sets.select("doc_id", "high", "low"), classes, ["high", "low"], BROADCAST_IDS).where("first <> doc_id").select("doc_id", "high", "low", "first"), "copies")
    # Copies are left out where they are few enough to broadcast; else they stay, and only link with what their class links with.
    ids = copies.select("doc_id", "high", "low").distinct()
    few = ids.count() <= BROADCAST_IDS
    different = sets.join(F.broadcast(ids) if few else ids, ["doc_id", "high", "low"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(global_order(found))
    met = members(different, shared)
    # Different texts under one doc_id are tied together by it: then a copy and the one that stands for its class are a link.
    several = sets.groupBy("doc_id").count().where("count > 1")
    tied = copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    grouped = saved(components(links(different, saved(met, "candidates"), shared).union(tied)), "components")
    # A copy not among them has the component of the one that stands for its class.
    firsts = copies.join(grouped, F.col("doc_id") == F.col("node"), "left_anti").select("doc_id", "first").distinct()
    stand = firsts.groupBy("first").agg(F.count("*").alias("copies")).join(grouped, F.col("first") == F.col("node"), "left").select("first", F.coalesce("component", "first").alias("component"), "copies")
    named = saved(grouped.select(F.col("node").alias("doc_id"), "component").unionByName(by_key(firsts, saved(stand, "stand"), ["first"], BROADCAST_IDS).select("doc_id", "component")), "named")
    few = named.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(named) if few else named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS MATERIALIZED (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2
"""
