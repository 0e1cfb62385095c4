"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of pairs of words are quantised to levels, level k holding counts from 2 ** (k - 1) to 2 ** k - 1, and an
n-gram of level k is in the filter k times, with 1 to k. How often an n-gram occurs is found by repeated membership probes: the
levels in turn until one is missing. A false positive can only add a level, ever more rarely.

The filter is a table of cells. Pairs go to a cell by their second word, whose own count is there too (in all its cells, if a
frequent word's pairs are dealt to several): a pair's probability needs only its cell and the first word's count, and the
logarithm of these is a difference, so that each part can be taken where it lies. Each cell is made by one task, from hashes
and counts that tasks have summed before the shuffle, and has as many bits as its entries need; the number of cells grows with
the corpus. Workers are broadcast as many cells at a time as fit ``SHARD`` bytes, and a document's score is the sum over those
passes: a larger corpus takes more passes, not a larger broadcast.

Smoothing is Dirichlet's at both orders: p(w) = (c(w) + A) / (N + A (V + 1)), p(w | h) = (c(h w) + M p(w)) / (c(h) + M).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import saved, table

#: Bits of an entry; of these so many are probed, in two words of a line of so many words: one place in memory.
BITS, PROBES, LINE = 12, 6, 8
#: Training tokens for each cell, and bytes of the cells that are broadcast at once.
CELL, SHARD = 1 << 20, 64 << 20
#: Words that occur at least once in so many training tokens are broadcast: there can't be more of them.
SHARE = 1_000_000
#: Pairs that a task holds before it sums them, and the weight of the lower order.
HELD, WEIGHT = 1 << 20, 50.0
ADDED = 0.1

_STEP, _TURN, _MIX, _NO_WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(1)


#: The token at the end of each text: no word is empty.
END = ""


def hashed(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _TURN
    x = (x ^ (x >> np.uint64(27))) * _MIX
    return x ^ (x >> np.uint64(31))


def pairs(word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it; starts are where texts begin, before which there is no word."""
    before = np.roll(word, 1)
    before[starts] = _NO_WORD
    return mixed(before * _STEP + word)


class Cells:
    """Where n-grams belong: ``count`` cells, and words whose pairs are dealt to several."""

    def __init__(self, count: int, spread: dict[str, int]):
        self.count = count
        order = sorted((xxh3_64_intdigest(w), k) for w, k in spread.items())
        self.words, self.over = np.array([h for h, _ in order], np.uint64), np.array([k for _, k in order], np.uint64)

    def home(self, word: np.ndarray) -> np.ndarray:
        return mixed(word + _STEP) % np.uint64(self.count)

    def ways(self, word: np.ndarray) -> np.ndarray:
        """To how many cells each word's pairs are dealt."""
        ways = np.ones(len(word), np.uint64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            known = self.words[at] == word
            ways[known] = self.over[at[known]]
        return ways


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]


#: The middle of each level's counts.
MIDDLE = np.array([0.0, *[(2.0 ** (k - 1) + 2.0**k - 1) / 2 for k in range(1, 64)]])


def _entry(grams: np.ndarray, level: int, lines: np.ndarray | np.uint64) -> tuple[np.ndarray, ...]:
    """Where entries (n-gram, level) are: two words of one line of LINE words, and the PROBES bits in them."""
    h = mixed(grams + np.uint64(level * int(_STEP) % (1 << 64)))
    line = ((h >> np.uint64(32)) * lines) >> np.uint64(32)
    other = mixed(h + _STEP)
    places, masks = [], []
    for k in range(2):
        places.append(line * np.uint64(LINE) + ((h >> np.uint64(3 * k)) & np.uint64(LINE - 1)))
        mask = np.zeros(len(grams), np.uint64)
        for j in range(k * PROBES // 2, (k + 1) * PROBES // 2):
            mask |= np.uint64(1) << ((other >> np.uint64(6 * j)) & np.uint64(63))
        masks.append(mask)
    return (*places, *masks)


def cell_bits(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """A cell's filter: lines of LINE words of 64 bits, BITS bits for each entry."""
    level = levels(counts)
    lines = max(1, -(-BITS * int(level.sum()) // (64 * LINE)))
    bits = np.zeros(lines * LINE, "<u8")
    for k in range(1, int(level.max(initial=0)) + 1):
        a, b, mask_a, mask_b = _entry(grams[level >= k], k, np.uint64(lines))
        np.bitwise_or.at(bits, a, mask_a)
        np.bitwise_or.at(bits, b, mask_b)
    return bits.tobytes()


class Filter:
    """Cells that a worker holds."""

    def __init__(self, cells: list[tuple[int, bytes]], count: int):
        self.first, self.size = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
        at = 0
        for cell, data in cells:
            self.size[cell], self.first[cell] = len(data) // (8 * LINE), at
            at += len(data) // 8
        self.bits = np.frombuffer(b"".join(d for _, d in cells), "<u8")

    def counts(self, grams: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """About how often each n-gram occurs, by probes for one level after another."""
        level = np.zeros(len(grams), np.int64)
        alive = np.arange(len(grams))
        for k in range(1, len(MIDDLE)):
            alive = self._found(grams, cells, alive, k)
            if not len(alive):
                break
            level[alive] = k
        return MIDDLE[level]

    def _found(self, grams: np.ndarray, cells: np.ndarray, alive: np.ndarray, level: int) -> np.ndarray:
        """Which of those alive are in the filter with this level."""
        of = cells[alive]
        a, b, mask_a, mask_b = _entry(grams[alive], level, self.size[of])
        first = self.first[of]
        there = (self.bits[a + first] & mask_a) == mask_a
        there &= (self.bits[b + first] & mask_b) == mask_b
        return alive[there]


def learned_from(id_col: str = "doc_id") -> Column:
    """Not of the tenth part that is held out; rows without an id are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(True))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens, ends included. Tasks sum before the shuffle, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            for some in _tokens(batch.column(0)):
                for word, n in zip(some.strings, np.bincount(some.which, minlength=len(some.strings)).tolist(), strict=True):
                    if n:
                        counts[word] += n
                if len(counts) > HELD // 4:
                    yield given()
        yield given()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def filter_table(texts: DataFrame, shared) -> DataFrame:
    """(cell, bits) of texts: a row a cell."""

    def summed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        cell, gram, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(gram)
        if cell.max() < 1 << 16:
            cell = cell.astype(np.uint16)  # few different keys are sorted in linear time
        order = order[np.argsort(cell[order], kind="stable")]
        cell, gram = cell[order], gram[order]
        new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (gram[1:] != gram[:-1])])
        counts = np.add.reduceat(times[order], new)
        cell, gram = cell[new].astype(np.int64), gram[new]
        at = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        parts = list(zip(at[:-1], at[1:], strict=True))
        yield pa.RecordBatch.from_pydict({"cell": cell[at[:-1]], "grams": [gram[a:b].tobytes() for a, b in parts], "counts": [_narrow(counts[a:b]) for a, b in parts]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = shared.value[0]
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for some in _tokens(batch.column(0)):
                at, home, ways = some.cells(cells)
                held.append((at, some.pair, np.ones(len(at), np.int64)))
                # A word's own count is in all cells of its pairs.
                times = np.bincount(some.which, minlength=len(home))
                for k in range(int(ways.max(initial=0))):
                    dealt = ways > k
                    held.append(((home[dealt] + k) % cells.count, some.words[dealt], times[dealt]))
                n += len(at) + len(home)
                if n > HELD:
                    yield from summed(held)
                    held, n = [], 0
        if n:
            yield from summed(held)

    def one(group: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()])
        counts = np.concatenate([_wide(x) for x in group.column("counts").to_pylist()])
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        new = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        return pa.table({"cell": group.column("cell")[:1], "bits": [cell_bits(grams[new], np.add.reduceat(counts, new))]})

    return texts.mapInArrow(run, "cell long, grams binary, counts binary").groupBy("cell").applyInArrow(one, "cell long, bits binary")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts of a byte each, those that don't fit after them."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(counts).to_bytes(4, "little") + small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def _wide(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    counts = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=4 + n)
    return counts


class Tokens:
    """Some texts' tokens: different words and their hashes, which of them each token is, hashes of pairs, and where each text
    begins. Words lie between white space (space, and 9 to 13), A-Z are lower-cased, and each
    text has an end; Arrow lower-cases, splits and numbers them."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.strings = [*coded.dictionary.to_numpy(zero_copy_only=False).tolist(), END]
        text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        if END in self.strings[:-1]:  # what is before the first and after the last white space
            real = which != self.strings.index(END)
            which, text = which[real], text[real]
        self.lengths = np.bincount(text, minlength=len(lists)) + 1
        ends = np.cumsum(self.lengths)
        self.starts = ends - self.lengths
        self.which = np.full(int(ends[-1]), len(self.strings) - 1)
        self.which[np.arange(len(which)) + text] = which
        self.words = hashed(self.strings)
        self.pair = pairs(self.words[self.which], self.starts)

    def cells(self, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each pair; each different word's first cell, and to how many its pairs are dealt."""
        home, ways = cells.home(self.words).astype(np.int64), cells.ways(self.words).astype(np.int64)
        at = home[self.which]
        if ways.max(initial=1) > 1:
            at = (at + (self.pair >> np.uint64(20)).astype(np.int64) % ways[self.which]) % cells.count
        return at, home, ways


def _tokens(texts: pa.Array) -> Iterator[Tokens]:
    """Texts of about a million bytes at a time, or a longer one."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) >> 20
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield Tokens(texts.slice(a, b - a))


def _log_sums(some: Tokens, cells: Cells, held: Filter, n: int, v: int) -> np.ndarray:
    """Per text the part of its log10 probability that the held cells give."""
    at, home, ways = some.cells(cells)
    parts = np.zeros(len(at))
    here = np.flatnonzero(held.size[at])
    # A word's count is in each of its cells: in the first one that is held here.
    single = np.zeros(len(home))
    left = np.arange(len(home))
    for k in range(int(ways.max(initial=0))):
        left = left[ways[left] > k]
        cell = (home[left] + k) % cells.count
        there = held.size[cell] > 0
        single[left[there]] = held.counts(some.words[left[there]], cell[there])
        left = left[~there]
    low = (single + ADDED) * (WEIGHT / (n + ADDED * (v + 1)))
    pair, first, which = np.unique(some.pair[here], return_index=True, return_inverse=True)
    parts[here] = np.log10(held.counts(pair, at[here[first]])[which] + low[some.which[here]])
    # What a token is divided by as the word before the next one, where its first cell is held.
    over = np.where(held.size[home] > 0, np.log10(single + WEIGHT), 0.0)[some.which]
    over[np.r_[some.starts[1:], len(at)] - 1] = 0.0
    return np.add.reduceat(parts - over, some.starts)


FIRST = "doc_id long, held_out boolean, key binary, n_tokens long, n_known long, known double, rare array<struct<word:string,n:bigint>>, part double"
LATER = "key binary, part double"


class Model:
    """What is learned from texts: exact counts of words, and the filter of words and pairs as a written table of cells."""

    def __init__(self, texts: DataFrame, shard: int = SHARD, cell: int = CELL, share: int = SHARE):
        self.spark = texts.sparkSession
        self.counts = saved(word_counts(texts), "words")
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
        self.n, self.v, self.texts = total
        #: Frequent words: at most ``share`` of them, whatever the corpus. The others' counts are joined.
        self.is_frequent = F.col("n") * share >= self.n
        self.frequent = {r.word: r.n for r in self.counts.where(self.is_frequent).toLocalIterator()}
        most = max(1, -(-self.n // cell))
        self.cells = Cells(most, {w: min(most, -(-k // cell)) for w, k in self.frequent.items() if k > cell})
        self.filter = saved(filter_table(texts, self.spark.sparkContext.broadcast((self.cells,))), "filter")
        size = F.octet_length("bits")
        self.shards = max(1, -(-(self.filter.agg(F.sum(size)).first()[0] or 0) // shard))
        while self.shards < most and self.filter.groupBy(self.shard()).agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0] > shard:
            self.shards = min(most, self.shards + max(1, self.shards // 4))

    def shard(self) -> Column:
        return F.floor(F.col("cell") * self.shards / self.cells.count)

    def part(self, k: int) -> Filter:
        """The k-th shard's cells: at most ``shard`` bytes, or one cell."""
        rows = self.filter.where(self.shard() == k).toArrow()
        return Filter(list(zip(rows.column("cell").to_pylist(), rows.column("bits").to_pylist(), strict=True)), self.cells.count)

    def base(self, count: float) -> float:
        return math.log10((count + ADDED) / (self.n + ADDED * (self.v + 1)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens of a text are its words and an end, so a null or empty text has one token. Rows that repeat, or have no id, are
    scored each by itself; other columns are left out, so none can clash. Very long texts are scored whole. A model of no text
    gives each token probability 1 by the base, as its formula says.
    """
    spark = docs.sparkSession
    flag = ~learned_from(id_col) if held_out is None else held_out
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), F.col(text_col).alias("text"))
    n, v, cells, base = model.n, model.v, model.cells, model.base
    logs = spark.sparkContext.broadcast({w: base(c) for w, c in model.frequent.items()})
    unseen = math.log10(model.texts + WEIGHT)  # what the first word of a text is divided by

    def one_pass(k: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(model.part(k))

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = 0
                for some in _tokens(batch.column(2)):
                    here = batch.slice(done, len(some.starts))
                    done += len(some.starts)
                    log = np.array([logs.value.get(w, 1.0) for w in some.strings])  # of frequent words; a log is never above 0
                    frequent = log <= 0
                    sums = [np.add.reduceat(x[some.which], some.starts) for x in (frequent.astype(np.int64), np.where(frequent, log, 0.0))]
                    parts = _log_sums(some, cells, shared.value, n, v) - unseen
                    columns = (here.column(0), here.column(1), pa.array(map(_key, here.column(2).to_pylist()), pa.binary()), some.lengths, *sums, _rare(some, ~frequent), parts)
                    yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "held_out", "key", "n_tokens", "n_known", "known", "rare", "part"), columns, strict=True)))

        def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [_log_sums(some, cells, shared.value, n, v) for some in _tokens(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(map(_key, batch.column(0).to_pylist()), pa.binary()), pa.array(np.concatenate(parts or [[]]), pa.float64())], names=["key", "part"])

        return saved(own.mapInArrow(first, FIRST) if not k else own.select("text").mapInArrow(later, LATER), f"pass-{k}")

    out = one_pass(0).withColumn("_row", F.monotonically_increasing_id())
    rest = [one_pass(k).groupBy("key").agg(F.max("part").alias("part")) for k in range(1, model.shards)]  # equal texts have equal parts
    if rest:
        more = reduce(DataFrame.unionByName, rest).groupBy("key").agg(F.sum("part").alias("_more"))
        out = out.join(more, "key", "left").withColumn("part", F.col("part") + F.col("_more"))
    rare = out.select("_row", F.explode("rare").alias("_r")).select("_row", "_r.word", F.col("_r.n").alias("times"))
    infrequent = model.counts.where(~model.is_frequent)
    seen = F.coalesce("n", F.lit(0))
    log = F.log10((seen + F.lit(ADDED)) / F.lit(n + ADDED * (v + 1)))
    sums = rare.join(infrequent, "word", "left").groupBy("_row").agg(F.sum(F.when(seen > 0, F.col("times"))).alias("_known"), F.sum(F.col("times") * log).alias("_log"))
    none = F.lit(0)
    return out.drop("rare", "key").join(sums, "_row", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", none)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("known") + F.coalesce("_log", none)).alias("base_score"), F.col("part").alias("score"),
    )


def _rare(some: Tokens, rare: np.ndarray) -> pa.Array:
    """Per text its rare words, and how often it has each."""
    at = np.flatnonzero(rare[some.which])
    text = np.repeat(np.arange(len(some.lengths)), some.lengths)[at]
    pair, times = np.unique(text * len(some.strings) + some.which[at], return_counts=True)
    text, word = np.divmod(pair, max(1, len(some.strings)))
    ends = np.r_[0, np.cumsum(np.bincount(text, minlength=len(some.lengths)))].astype(np.int32)
    words = pa.array(some.strings, pa.string()).take(pa.array(word, pa.int64()))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], names=["word", "n"]))


def _key(text: str | None) -> bytes:
    return xxh3_128_digest((text or "").encode())


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores() of all documents by a Model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, Model(docs.where(learned_from()).select("text")))
