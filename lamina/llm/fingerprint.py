"""I-Match fingerprints with randomised lexicons, by DataFrame functions only.

The lexicon is the terms whose inverse document frequency among distinct texts lies in a band. A text with few of them is
described by its rarest other terms too, so that near copies which are many, or of rare terms only, keep their likeness. It is dealt at random into subsets, and a share of
it into smaller ones beside them. A text's terms in the lexicon are made distinct and sorted, and those of each subset are
hashed: one component of the fingerprint for each subset. Likeness is the share of equal components among those that either
text has terms for: changed terms change the components of their subsets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Terms that this share of the distinct texts or more, and this share at most, contain are in the lexicon; always two at least.
#: With the lower share at 1/2000 there are at most 2000 times as many such terms as a text has on average.
RARE, COMMON = 1 / 2000, 1 / 4
#: A text with fewer terms in the lexicon has its other ones added up to so many: those rarer than the band first, then the
#: more frequent ones from the rarest; among equals by their hash.
FEWEST = 24
#: Subsets that the whole lexicon is dealt into, and those that one term in SPARSE is dealt into.
SUBSETS, SPARSE_SUBSETS, SPARSE = 96, 32, 8
#: The lexicon is broadcast up to so many terms (24 bytes each), and so are hashes of repeated texts; beyond, the join is shuffled.
BROADCAST_TERMS = 2_000_000
#: Cells that doc_ids are counted in, and rows of a run of neighbouring cells in which next rows are found.
CELLS, RUN_ROWS = 16_384, 500
_LOW = (1 << 56) - 1


def terms(text: Column) -> Column:
    """Distinct terms of a text: lower-cased runs of letters and digits, and always an empty one first."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), r"[^\p{L}\p{N}]+")))


def distinct_texts(texts: DataFrame) -> tuple[DataFrame, int]:
    """Each text once, and their number. Only texts that are repeated are shuffled, once for each task that has them."""
    hashed = texts.select(F.xxhash64("text").alias("whole"), "text")
    copies = saved(hashed.groupBy("whole").count(), "copies")
    repeated = copies.where("count > 1").select("whole", F.lit(True).alias("repeated"))
    few = repeated.count() <= BROADCAST_TERMS
    marked = hashed.join(F.broadcast(repeated) if few else repeated, "whole", "left")
    once = marked.where("repeated").groupBy("whole").agg(F.first("text").alias("text"))
    return marked.where("repeated is null").select("text").union(once.select("text")), copies.count()


def entries_of(term: Column) -> Column:
    """A term's entries (subset, then hash), one for each of its subsets: always one below SUBSETS, for some one of the others."""
    dealt = F.pmod(F.xxhash64(term, F.lit(1)), F.lit(SUBSETS))
    sparse = F.when(F.pmod(F.xxhash64(term, F.lit(2)), F.lit(SPARSE)) == 0, F.pmod(F.xxhash64(term, F.lit(3)), F.lit(SPARSE_SUBSETS)) + SUBSETS)
    return F.array_compact(F.array(*(F.shiftleft(k.cast("long"), 56).bitwiseOR(term.bitwiseAND(_LOW)) for k in (dealt, sparse))))


def lexicon(texts: DataFrame) -> DataFrame:
    """(term, entry, often): a 64-bit hash of each term in the band, with each of its entries; and of each term above the
    band, without an entry, with its count. Of the latter there are at most 1 / COMMON times as many as a text has on average.

    Each text counts once. Counts are summed in each task before they are shuffled.
    """
    once, n = distinct_texts(texts)
    counts = once.select(F.explode(terms(F.col("text"))).alias("word")).where("word <> ''").groupBy(F.xxhash64("word").alias("term")).count()
    known = counts.where(F.col("count") >= max(2.0, RARE * n)).withColumn("often", F.when(F.col("count") > COMMON * n, F.col("count")))
    return known.select("term", F.explode_outer(F.when(F.col("often").isNull(), entries_of(F.col("term")))).alias("entry"), "often")


def with_others(entries: Column, others: Column) -> Column:
    """entries of the terms in the lexicon and, up to FEWEST terms, those of the first others (often, term)."""
    known = F.size(F.filter(entries, lambda e: e < F.lit(SUBSETS << 56)))
    added = F.slice(F.sort_array(others), F.lit(1), F.lit(FEWEST) - known)
    return F.when(known >= FEWEST, entries).otherwise(F.concat(entries, F.flatten(F.transform(added, lambda x: entries_of(x["term"])))))


def components(entries: Column) -> Column:
    """For each subset 0 if no entry is in it, else a hash (1 to 65535) of its sorted terms.

    Marks between the subsets are sorted in with the entries; the joined terms are then cut at the marks.
    """
    marks = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS + SPARSE_SUBSETS - 1)), lambda k: F.shiftleft(k.cast("long"), 56))
    joined = F.array_join(F.transform(F.sort_array(F.concat(entries, marks)), lambda x: F.when(x.bitwiseAND(_LOW) == 0, "|").otherwise(x.cast("string"))), " ")
    parts = F.slice(F.split(joined, r"\|"), 2, SUBSETS + SPARSE_SUBSETS)
    return F.transform(parts, lambda s: F.when(F.trim(s) == "", 0).otherwise(F.pmod(F.xxhash64(F.trim(s)), F.lit(65535)) + 1).cast("int"))


def written(parts: Column, whole: Column) -> Column:
    """The fingerprint as a string: four hex digits a component; a hash of the whole text if it has no term."""
    return F.when(F.array_max(parts) > 0, F.lower(F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(x), 4, "0")), ""))).otherwise(F.concat(F.lit("text-"), F.hex(whole)))


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Equal components among those that either has, from 0 to 1; without any, 1 for equal texts and 0 for others."""
    one = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 65537).otherwise(1))
    total = F.aggregate(one, F.lit(0), lambda s, x: s + x)
    either = total.bitwiseAND(65535)
    return F.when(either > 0, F.shiftright(total, 16) / either).otherwise((whole_a == whole_b).cast("double"))


def in_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with h, a hash of the text, and run: neighbours by doc_id, then h, share a run of about RUN_ROWS rows.
    Each run also has the row that follows its last one in descending order, the largest of the run below (below the lowest: of
    all), as a guest.

    doc_ids are counted in cells of equal width, named by where they begin; cells with many times more rows than others are
    cut again between their own ends, CELLS at most in each round, and cells of one doc_id by h. All cells are gathered into
    runs. Rows with equal doc_id and text can't be told apart, and aren't cut. A row without a doc_id comes after all others.
    """
    low, high, total = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, top = (low or 0) - 1, high or 0
    numbered = docs.withColumns({"number": F.coalesce("doc_id", F.lit(low)), "h": F.shiftrightunsigned(F.xxhash64("text"), 1)})
    number = F.col("number")
    most = max(RUN_ROWS, 8 * total // CELLS)
    placed = numbered.withColumn("cell", number - F.pmod(number - F.lit(low), F.lit(-(-(top - low + 1) // CELLS))))
    while True:
        counts = saved(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("number").alias("least"), F.max("number").alias("top")), "cells")
        full = counts.where((F.col("n") > most) & (F.col("least") < F.col("top"))).collect()  # fewer than CELLS / 8
        if not full:
            break
        finer = [(r.cell, r.least, -(-(r.top - r.least + 1) // -(-CELLS * r.n // total))) for r in full]
        parts = docs.sparkSession.createDataFrame(finer, "cell long, start long, width long")
        placed = placed.join(F.broadcast(parts), "cell", "left").withColumn("cell", F.coalesce(number - F.pmod(number - F.col("start"), F.col("width")), "cell")).drop("start", "width")
    single = counts.where(F.col("n") > most).select("cell", F.ceil(F.lit(CELLS) * F.col("n") / total).alias("parts"))  # fewer than CELLS / 8
    cut = placed.join(F.broadcast(single), "cell", "left").withColumn("sub", F.coalesce(F.shiftright(F.shiftright("h", 31) * F.col("parts"), 32), F.lit(0)))
    counts = saved(cut.groupBy("cell", "sub").agg(F.count("*").alias("n"), F.max(F.struct("number", "h")).alias("top")), "cells")
    before = F.sum("n").over(Window.orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1))
    runs = saved(counts.select("cell", "sub", "top", F.floor(F.coalesce(before, F.lit(0)) / RUN_ROWS).cast("int").alias("run")), "runs")
    tops = runs.groupBy("run").agg(F.max("top").alias("top"))
    last = runs.agg(F.max("top").alias("top")).first()["top"]
    highest = F.struct(F.lit(last["number"] if last else 0).cast("long").alias("number"), F.lit(last["h"] if last else 0).cast("long").alias("h"))
    below = tops.select("run", F.coalesce(F.lag("top").over(Window.orderBy("run")), highest).alias("b")).select("run", "b.number", "b.h")
    # Both tables have CELLS rows at most, and as many again for each round.
    own = cut.join(F.broadcast(runs.select("cell", "sub", "run")), ["cell", "sub"]).select("doc_id", "text", "h", "run", F.lit(False).alias("guest"))
    guests = numbered.join(F.broadcast(below), ["number", "h"]).groupBy("run").agg(F.first(F.struct("doc_id", "text", "h")).alias("g")).select("g.*", "run", F.lit(True).alias("guest"))
    return own.unionByName(guests)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next row's, by
    descending doc_id, then a hash of the text, then the text; the last row is followed by the first. A null text counts as empty; a null doc_id comes
    last. Equal texts have equal fingerprints. Rows that repeat each have a row; other columns are left out, so none can clash;
    an empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = saved(lexicon(texts), "lexicon")
    few = known.count() <= BROADCAST_TERMS
    order = Window.partitionBy("run").orderBy("guest", F.desc("doc_id"), F.desc("h"), F.desc("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = (
        in_runs(texts)
        .select("run", "guest", "doc_id", "text", F.char_length("text").alias("n"), F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("at"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    )
    described = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "whole": F.xxhash64("text"), "edited_whole": F.xxhash64("edited"), "words": F.array(terms(F.col("text")), terms(F.col("edited")))})
    sides = described.select("run", "at", F.struct("guest", "doc_id", "n", "edited_sha256", "whole", "edited_whole").alias("about"), F.posexplode("words").alias("side", "words"))
    words = sides.select("run", "at", "about", "side", F.explode("words").alias("word"))
    # What is known of a row travels with its empty term only.
    thin = words.select("run", "at", "side", F.xxhash64("word").alias("term"), F.when(F.col("word") == "", F.col("about")).alias("about"))
    other = F.when(F.col("entry").isNull() & F.col("about").isNull(), F.struct(F.coalesce("often", F.lit(0)).alias("often"), "term"))
    matched = thin.join(F.broadcast(known) if few else known, "term", "left").groupBy("run", "at", "side").agg(F.collect_list("entry").alias("entries"), F.collect_list(other).alias("others"), F.first("about", ignorenulls=True).alias("about"))
    parts = matched.select("run", "at", "side", "about", components(with_others(F.col("entries"), F.col("others"))).alias("parts"))
    both = parts.groupBy("run", "at").agg(F.first("about").alias("a"), F.first(F.when(F.col("side") == 0, F.col("parts")), ignorenulls=True).alias("p"), F.first(F.when(F.col("side") == 1, F.col("parts")), ignorenulls=True).alias("q"))
    after = Window.partitionBy("run").orderBy("at")
    nexts = both.withColumn("next", F.lead(F.struct("p", F.col("a.whole").alias("whole"))).over(after)).where("not a.guest")
    return nexts.select(
        "a.doc_id", F.col("a.n").cast("long").alias("n_chars"), "a.edited_sha256",
        written(F.col("p"), F.col("a.whole")).alias("fingerprint"), written(F.col("q"), F.col("a.edited_whole")).alias("edited_fingerprint"),
        likeness(F.col("p"), F.col("q"), F.col("a.whole"), F.col("a.edited_whole")).alias("near_edited"),
        F.coalesce(likeness(F.col("p"), F.col("next.p"), F.col("a.whole"), F.col("next.whole")), F.lit(0.0)).alias("near_next"),
    )


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints() of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
