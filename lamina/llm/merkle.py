"""A Merkle manifest of a table by time-forward processing.

A tree is a graph whose nodes are labelled so that every node comes after its children. A forward sweep takes nodes in that
order: a priority queue ordered by label holds the digests on their way to parents, and a node is made when all that was sent
to its label is on top. The reversed sweep takes nodes from the root down: each hands its children the suffix of their proofs,
what their sibling is and what it has been handed itself.

The queue is external in this way: trees are cut into blocks of 2 ** ``LEVELS`` neighbouring leaves, which are whole subtrees. Within
a block labels are in post-order, so the queue never holds more than a digest for each level. What leaves a block, its top, is
a message to the block of tops above, and Spark's sorted shuffle delivers it; blocks of blocks follow, tier by tier, until each
tree is one block. Every tier is a written table with a block's part of the rows of the one below, so a lost executor costs some
blocks, and no task holds more than a block. Then proof suffixes go down through the same tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_key, saved, table

#: Leaves of a block are two to this power; entries of a broadcast table of offsets or suffixes at most.
LEVELS, BROADCAST = 8, 100_000

#: What a leaf is made of, in order (fixed by the contract).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """sha256 of fields, each as its UTF-8 byte count, a colon and its value, or a minus sign if null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _label(level: int, index: int) -> int:
    """A node's place in the post-order of the whole binary tree: after both children, before its parent."""
    last = (index + 1 << level) - 1  # the last leaf below it
    return 2 * last - last.bit_count() + level


def rise(leaves: list[str], levels: int) -> tuple[list[list[str]], int]:
    """Digests of all nodes of a block by level, its leaves first, by time-forward processing; and how many were in the queue at once."""
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    queue: list[tuple[int, int, int, str]] = []  # the receiver's label, its level, the child's index, what is sent
    most = 0
    coming = iter(enumerate(leaves))
    following = next(coming, None)
    while following or queue:
        # A leaf is due before a parent whose label is greater.
        if following and (not queue or _label(0, following[0]) < queue[0][0]):
            level, index, made = 0, *following
            following = next(coming, None)
        else:
            label, level, child, sent = heapq.heappop(queue)
            index = child >> 1
            while queue and queue[0][0] == label:
                sent += heapq.heappop(queue)[3]
            made = digest(sent)
        nodes[level].append(made)
        if level < levels:
            heapq.heappush(queue, (_label(level + 1, index >> 1), level + 1, index, made))
            most = max(most, len(queue))
    return nodes, most


def fall(nodes: list[list[str]], suffix: tuple[str, str]) -> list[tuple[str, str]]:
    """For each leaf of a block its proof (siblings' digests upwards) and sides, from the suffix that the block's top is handed.

    sides has a letter a level: ``l`` and ``r`` where the sibling is at the left and right, ``-`` where there is none.
    """
    queue = [(0, len(nodes) - 1, 0, suffix)]  # minus the receiver's label: the root comes first
    out: list = [None] * len(nodes[0])
    while queue:
        _, level, index, (proof, sides) = heapq.heappop(queue)
        if not level:
            out[index] = (proof, sides)
            continue
        below, a = nodes[level - 1], 2 * index
        if a + 1 < len(below):
            heapq.heappush(queue, (-_label(level - 1, a + 1), level - 1, a + 1, (below[a] + proof, "l" + sides)))
            heapq.heappush(queue, (-_label(level - 1, a), level - 1, a, (below[a + 1] + proof, "r" + sides)))
        else:
            heapq.heappush(queue, (-_label(level - 1, a), level - 1, a, (proof, "-" + sides)))
    return out


def folded(leaf: str, proof: str, sides: str) -> str:
    """The root that a leaf and its proof give."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = digest(leaf)
        else:
            sibling = proof[at : at + 64]
            leaf, at = digest(sibling, leaf) if side == "l" else digest(leaf, sibling), at + 64
    return leaf


def _levels(block: int, n: int, levels: int) -> int:
    """How far a block's leaves rise: to one node; a block of several of one tree to the tier above."""
    return levels if block else (n - 1).bit_length()


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``rank``, counted from 0 within each group in the order, nulls first.

    Rows are sorted once, over all groups: a group of any size, and rows that repeat, are spread over tasks. rows must be a
    written table, so that what tells equal rows apart is the same each time.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("_at", F.monotonically_increasing_id())
    by = [F.asc_nulls_first(c) for c in (group, *order, "_at")]
    kept = [F.col(c) for c in rows.columns]
    out = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept, F.spark_partition_id().alias("_part"))
    at = out.columns.index(group)
    types = out.select(*kept).schema.simpleString()[7:-1]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            places = []
            for g in batch.column(at).to_pylist():
                n = n + 1 if g == last else 0
                last = g
                places.append(n)
            yield batch.append_column("_place", pa.array(places, pa.int64()))

    placed = saved(out.mapInArrow(numbered, f"{types}, _part int, _place long"), "placed")
    # A row for each group of each task: as many as tasks and groups, whatever the number of rows.
    counts = placed.groupBy("_part", group).agg((F.max("_place") + 1).alias("copies"))
    before = F.sum("copies").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = saved(counts.withColumn("_before", F.coalesce(before, F.lit(0))), "offsets")
    return by_key(placed, offsets, ["_part", group], BROADCAST).withColumn("rank", F.col("_before") + F.col("_place")).select(*kept, "rank")


def _blocks(name: str, levels: int):
    """For applyInArrow: a block's row, from its nodes."""

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        leaves = group.column("digest").to_pylist()
        top = rise(leaves, _levels(group.column("block")[0].as_py(), len(leaves), levels))[0][-1][0]
        columns = {"tree": group.column("tree")[:1], "block": group.column("block")[:1], "nodes": [b"".join(map(bytes.fromhex, leaves))], "top": [top]}
        if name:
            values = group.column(name).combine_chunks()
            columns[name] = pa.ListArray.from_arrays([0, len(leaves)], values, type=pa.list_(pa.field("element", values.type)))
        return pa.table(columns)

    return one


def climbed(nodes: DataFrame, levels: int, extra: str | None = None) -> list[DataFrame]:
    """The tiers of trees from (tree, rank, digest), the lowest first: (tree, block, nodes, top, and extra of the lowest one's
    nodes). The last tier has one block a tree, whose top is the root."""
    tiers: list[DataFrame] = []
    name, _, kind = (extra or "").partition(" ")
    while True:
        keyed = nodes.withColumn("block", F.shiftright("rank", levels))
        more = f", {name} array<{kind}>" if name else ""
        tier = saved(keyed.groupBy("tree", "block").applyInArrow(_blocks(name, levels), f"tree string, block long, nodes binary, top string{more}"), f"tier-{len(tiers)}")
        tiers.append(tier)
        if not tier.agg(F.max("block")).first()[0]:
            return tiers
        nodes, name = tier.select("tree", F.col("block").alias("rank"), F.col("top").alias("digest")), ""


def _leaves(name: str, levels: int):
    """For mapInArrow: the leaves of blocks, with their proofs, from blocks and what their tops are handed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns([name] if name else []).to_pylist()):
                text = row["nodes"].hex()
                leaves = [text[at : at + 64] for at in range(0, len(text), 64)]
                nodes, _ = rise(leaves, _levels(row["block"], len(leaves), levels))
                found = fall(nodes, (row["proof"], row["sides"]))
                first = row["block"] << levels
                columns = {"tree": [row["tree"]] * len(leaves), "rank": range(first, first + len(leaves)), "leaf": leaves, "proof": [p for p, _ in found], "sides": [s for _, s in found]}
                yield pa.RecordBatch.from_pydict(columns | ({name: batch.column(name)[k].values} if name else {}))

    return run


def descended(tiers: list[DataFrame], suffixes: DataFrame, levels: int, extra: str | None = None) -> DataFrame:
    """(tree, rank, leaf, proof, sides, and extra) of all leaves, from what each tree's root is handed: (tree, proof, sides)."""
    above = suffixes.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(tiers))):
        name, _, kind = (extra or "").partition(" ") if not k else ("", "", "")
        few = tiers[k].count() <= BROADCAST  # blocks of this tier, so rows of above
        met = tiers[k].drop("top").join(F.broadcast(above) if few else above, ["tree", "block"])
        below = met.mapInArrow(_leaves(name, levels), f"tree string, rank long, leaf string, proof string, sides string{f', {name} {kind}' if name else ''}")
        if k:
            above = saved(below.select("tree", F.col("rank").alias("block"), "proof", "sides"), f"suffixes-{k}")
    return below


EXTRA = "ids struct<id:bigint,changed:string>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lang string, n_siblings int"


def manifest(docs: DataFrame, changed: Column, id_col: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """Per row: id, leaf, subroot of its group's tree, root over all groups' subroots, proof_sha256, folded_root, verified, group, n_siblings.

    ``changed`` is the leaf digest that a row is verified with: leaf_digest() of the fields as they are now. It's folded with
    the proof that the original leaf has. Leaves of a group ascend by id (nulls first), rows of one id by their digests, so the
    root depends on rows only, not on their order; repeated rows are a leaf each. A null group is a group of its own, before
    all others. Blocks have 2 ** levels leaves, which changes no result. Columns beside the fields don't count. Empty and very long texts are hashed like others; an empty table has no
    row and no root.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), leaf_digest(*[F.col(f"`{f}`") for f in fields]).alias("digest"), changed.alias("_changed"))
    leaves = saved(own.select("id", "tree", "digest", F.when(F.col("_changed") != F.col("digest"), F.col("_changed")).alias("changed")), "leaves")
    placed = ranked(leaves, "tree", ["id", "digest", "changed"])
    tiers = climbed(placed.select("tree", "rank", "digest", F.struct("id", "changed").alias("ids")), levels, EXTRA)
    # The subroots are the leaves of one more tree.
    subroots = tiers[-1].select(F.col("tree").alias("group"), F.col("top").alias("digest"))
    tops = ranked(saved(subroots.withColumn("all", F.lit("")), "subroots"), "all", ["group"])
    upper = climbed(tops.select(F.lit("").alias("tree"), "rank", "digest", F.col("group").alias("group")), levels, "group string")
    root = (upper[-1].select("top").first() or [""])[0]
    paths = descended(upper, docs.sparkSession.createDataFrame([("", "", "")], "tree string, proof string, sides string"), levels, "group string")
    handed = saved(paths.select(F.col("group").alias("tree"), "proof", "sides", F.col("leaf").alias("subroot")), "handed")
    found = descended(tiers, handed.drop("subroot"), levels, EXTRA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, leaf, proof, sides, ids, subroot = (batch.column(c).to_pylist() for c in ("tree", "leaf", "proof", "sides", "ids", "subroot"))
            now = [folded(x["changed"] or a, p, s) for x, a, p, s in zip(ids, leaf, proof, sides, strict=True)]
            out = ([x["id"] for x in ids], leaf, subroot, [root] * len(now), [digest(p) for p in proof], now, [x == root for x in now], [t[1:] if t else None for t in tree], [len(p) // 64 for p in proof])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.string(), pa.int32()), strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    # A row for each group; the number of rows that have one decides nothing but how it's joined.
    named = by_key(found.withColumn("_tree", F.col("tree")), _counted(handed, tiers[0]), ["_tree"], BROADCAST)
    return named.select("tree", "leaf", "proof", "sides", "ids", "subroot").mapInArrow(run, RESULT).withColumnsRenamed({"doc_id": id_col, "lang": group})


def _counted(handed: DataFrame, lowest: DataFrame) -> DataFrame:
    """(_tree, subroot, copies): each group's subroot, and how many leaves it has."""
    sizes = lowest.groupBy("tree").agg((F.sum(F.octet_length("nodes")) / 32).cast("long").alias("copies"))
    return saved(handed.join(sizes, "tree").select(F.col("tree").alias("_tree"), "subroot", "copies"), "subroots")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest() of all documents; where 7 divides the id's crc32, n_chars has become one more since."""
    docs = table(spark, sf_dir, "documents")
    now = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(docs, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), now, F.col("text")))


#: crc32 of an id in SQL: each byte is folded in, then shifted out bit by bit (the polynomial is a fixed value).
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: 0::UBIGINT)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, source, n_chars, text, CASE WHEN coalesce({_CRC} % 7 = 0, false) THEN n_chars + 1 ELSE n_chars END AS now FROM documents),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS a, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS z FROM d),
h AS (SELECT doc_id, coalesce('=' || lang, '') AS g, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') || z) AS leaf, sha256(a || coalesce(strlen(now::VARCHAR)::VARCHAR || ':' || now::VARCHAR, '-') || z) AS changed FROM f),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
up AS (SELECT g, 0 AS lev, i, leaf AS dig, n FROM l UNION ALL
  SELECT g, lev + 1, i // 2, sha256(string_agg(dig, '' ORDER BY i)), any_value((n + 1) // 2) FROM up WHERE n > 1 GROUP BY g, lev, i // 2),
u AS MATERIALIZED (SELECT * FROM up),
sub AS MATERIALIZED (SELECT g, dig, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM u WHERE n = 1),
top AS (SELECT 0 AS lev, i, dig, n FROM sub UNION ALL SELECT lev + 1, i // 2, sha256(string_agg(dig, '' ORDER BY i)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY lev, i // 2),
t AS MATERIALIZED (SELECT * FROM top),
steps AS MATERIALIZED (SELECT l.g, l.i, s.lev, s.i % 2 = 1 AS right_one, o.dig AS sib FROM l JOIN u s ON s.g = l.g AND s.i = l.i >> s.lev AND s.n > 1 LEFT JOIN u o ON o.g = s.g AND o.lev = s.lev AND o.i = xor(s.i, 1)
  UNION ALL SELECT l.g, l.i, 1000 + s.lev, s.i % 2 = 1, o.dig FROM l JOIN sub ON sub.g = l.g JOIN t s ON s.i = sub.i >> s.lev AND s.n > 1 LEFT JOIN t o ON o.lev = s.lev AND o.i = xor(s.i, 1)),
path AS MATERIALIZED (SELECT g, i, row_number() OVER (PARTITION BY g, i ORDER BY lev) AS k, right_one, sib FROM steps),
proof AS (SELECT l.g, l.i, sha256(coalesce(string_agg(sib, '' ORDER BY k), '')) AS proof_sha256, count(sib)::INT AS n_siblings FROM l LEFT JOIN path p ON p.g = l.g AND p.i = l.i GROUP BY 1, 2),
fold AS (SELECT g, i, 0::BIGINT AS k, changed AS dig FROM l UNION ALL SELECT p.g, p.i, p.k, sha256(CASE WHEN p.sib IS NULL THEN f.dig WHEN p.right_one THEN p.sib || f.dig ELSE f.dig || p.sib END) FROM fold f JOIN path p ON p.g = f.g AND p.i = f.i AND p.k = f.k + 1),
last AS (SELECT g, i, arg_max(dig, k) AS folded_root FROM fold GROUP BY 1, 2)
SELECT l.doc_id, l.leaf, sub.dig AS subroot, r.dig AS root, proof_sha256, folded_root, folded_root = r.dig AS verified, l.lang, n_siblings
FROM l JOIN sub ON sub.g = l.g JOIN proof p ON p.g = l.g AND p.i = l.i JOIN last ON last.g = l.g AND last.i = l.i, (SELECT dig FROM t WHERE n = 1) r
"""
