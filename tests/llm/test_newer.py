"""Manifest, hard negatives and language-model scores against brute force, with odd rows of all kinds."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import common, merkle, negatives, ngrams, packing

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, now=None):
    values = [*row[:3], row[3] if now is None else now, row[4]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """All levels of a tree, by its definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([sha(*a[k : k + 2]) for k in range(0, len(a), 2)])
    return levels


def manifest_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, climb([leaf(r) for r in own])))
    upper = climb([t[-1][0] for _, t in trees])
    out = []
    for k, (own, tree) in enumerate(trees):
        for i, r in enumerate(own):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            proof, now = [], leaf(r, r[3] + 1) if changed else leaf(r)
            for levels, at in ((tree, i), (upper, k)):
                for level in levels[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    proof += [x for j, x in enumerate(run) if j != at % 2]
                    now = sha(*[now if j == at % 2 else x for j, x in enumerate(run)])
                    at //= 2
            out.append((r[0], leaf(r), tree[-1][0], upper[-1][0], sha(*proof), now, now == upper[-1][0]))
    return sorted(out, key=str)


def made(spark, rows, levels):
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("rank", "tree", "block", "digest", "ids", "id", "leaf")})
    now = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(docs, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), now, F.col("text")), levels=levels)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()), key=str)


ODD = [(None, None, None, None, None), (None, "s", "en", 3, "abc"), (5, "s", "en", None, ""), (5, "s", "en", 3, "é日本"), (5, "s", "en", 3, "é日本"), (9, "s", "", 1, "x"), (10, "s", "zz", 200_000, "long " * 40_000), (-3, "", "é", 0, "a\x00b")]


@pytest.mark.parametrize("rows, levels", [(ODD, 1), ([(i, "s", ("en", "de", None)[i % 37 % 3], i, f"t{i}") for i in range(101)], 2), ([(7, "s", "en", 1, "same")] * 37, 8)])
def test_manifest_is_brute_forces(spark, rows, levels):
    assert made(spark, rows, levels) == manifest_of(rows)


def test_manifest_of_no_rows(spark):
    assert made(spark, [], 8) == []


def test_queue_holds_a_digest_a_level():
    leaves = [sha(str(k)) for k in range(256)]
    nodes, most = merkle.rise(leaves, 8)
    assert most <= 9
    assert [list(x) for x in nodes] == climb(leaves)
    for (proof, sides), x in zip(merkle.fall(nodes, ("", "")), leaves, strict=True):
        assert merkle.folded(x, proof, sides) == nodes[-1][0]


def negatives_of(rows, every):
    """By the definition; rows are (vec_id, label, vector)."""
    ok = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, l, v in ok:
        if i % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in ok if j != i and len(w) == len(v))
            for p, j, m in [x for x in near if x[2] == l][:5]:
                window = [x for x in near if x[2] != l and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
                out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(window)]
    return sorted(out)


def vectors(kind):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        centres = rng.normal(size=(6, 8))
        return [(i, int(rng.integers(3)), (centres[i % 6] + rng.normal(size=8) / 5).tolist()) for i in range(900)]
    if kind == "noise":
        return [(i, i % 3, rng.normal(size=8).tolist()) for i in range(500)]
    if kind == "equal":  # a third of all rows is one vector, scores tie
        return [(i, i % 2, [0.5, 0.25] if i % 3 == 0 else [0.01 * (i % 7), -0.5]) for i in range(700)]
    nan, inf = float("nan"), float("inf")
    return [(0, 1, [1.0, 0.0]), (0, 1, [0.9, 0.1]), (None, 1, [1.0, 1.0]), (1, None, [1.0, 1.0]), (2, 1, None), (3, 1, [nan, 0.0]), (4, 2, [inf, 0.0]), (5, 2, [None, 1.0]), (6, 1, [0.9, 0.0]), (6, 1, [0.9, 0.0]), (7, 2, [0.85, 0.0]), (8, 2, [0.85, 0.1]), (9, 2, [1.0]), (10, 1, [1.0]), (11, 1, [0.5]), (20, 1, []), (21, 1, []), (22, 2, []), (23, 1, [0.0, 0.0]), (30, 1, [-1.0, 0.0]), (31, 2, [4000.0, 3.0])]


@pytest.mark.parametrize("kind, batch", [("clusters", 20_000), ("noise", negatives.BATCH), ("equal", negatives.BATCH), ("odd", 20_000)])
def test_hard_negatives_are_brute_forces(spark, monkeypatch, kind, batch):
    monkeypatch.setattr(negatives, "BATCH", batch)
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("mine") for c in ("block", "place", "vector", "number", "rank", "score", "dims")})
    found = negatives.hard_negatives(df, 10)
    assert sorted(tuple(r) for r in found.collect()) == negatives_of(rows, 10)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert negatives.hard_negatives(df).count() == 0


def test_bounds_hold_and_choose():
    rng = np.random.default_rng(1)
    for scale in (40, 10**9):
        a, m = rng.integers(-scale, scale, (5, 6)), rng.integers(-scale, scale, (50, 6)) // 10**3 + 7
        low, high = negatives.bounds(a, m.min(0)[None], m.max(0)[None])
        scores = negatives.products(a, m)
        assert (scores == a.astype(object) @ m.T.astype(object)).all()
        assert (low[:, 0] <= scores.min(1)).all() and (scores.max(1) <= high[:, 0]).all()


def test_curve_visits_neighbours():
    for bits, n in ((2, 3), (3, 2), (1, 6)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        places = negatives.hilbert(points, bits)
        assert sorted(places) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(places)], axis=0)).sum(1) == 1).all()


def test_far_blocks_are_not_read(spark):
    """Two groups far apart: no anchor reads the other one's blocks for its positives."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, ([4.0] * 4 + [0.0] * 4 if i < 2000 else [0.0] * 4 + [4.0] * 4) + rng.normal(size=8) / 50) for i in range(4000)]
    df = spark.createDataFrame([(i, l, v.tolist()) for i, l, v in rows], "vec_id long, label int, embedding array<double>")
    blocks = negatives.filed(negatives.taking_part(df, "vec_id", "label", "embedding"))
    anchors = negatives.anchors_of(blocks, 100).withColumn("number", F.monotonically_increasing_id()).where("anchor_id < 2000").collect()
    asked = negatives.wanted(blocks, spark.sparkContext.broadcast(negatives.Batch(anchors)), True)
    assert 0 < asked.count() <= 0.6 * blocks.count()


@pytest.mark.parametrize("table", ["embeddings"])
def test_hard_negatives_query(spark, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.1/{table}.parquet'")
    expected = sorted(tuple(map(int, r)) for r in con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({negatives.OP12_SQL})").fetchall())
    assert sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, "/root/testdata/sf0.1").collect()) == expected


TEXTS = [None, "", " \n\t", "A b A b", "a\x0bb\x0cc\x1cd é\xa0É", "the cat sat on the mat " * 500, "the cat sat", "word " * 20_000, "日本語 の テキスト", "x" * 50_000] + [f"the cat number {i} sat on mat {i % 7}" for i in range(60)]


def base_of(rows):
    tokens = [(i, [*[w.decode() for w in (t or "").encode().lower().split()], ""]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, ws), h in zip(tokens, held, strict=True)]


def exact_scores(rows):
    """The model's scores with exact counts, and with counts as their levels say."""
    tokens = [[*[w.decode() for w in (t or "").encode().lower().split()], ""] for _, t in rows]
    train = [ws for (i, _), ws in zip(rows, tokens, strict=True) if i is None or zlib.crc32(str(i).encode()) % 10]
    one, two = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([None, *ws], ws))
    n, v = sum(one.values()), len(one)
    about = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0
    m = ngrams.WEIGHT
    return [sum(math.log10((about(two[a, w]) + m * (about(one[w]) + 0.1) / (n + 0.1 * (v + 1))) / ((len(train) if a is None else about(one[a])) + m)) for a, w in zip([None, *ws], ws)) for ws in tokens]


@pytest.mark.parametrize("shard, cell, share", [(ngrams.SHARD, ngrams.CELL, ngrams.SHARE), (600, 500, 40)])
def test_scores_by_any_shards(spark, shard, cell, share):
    """Whatever is broadcast at once and however pairs of frequent words are dealt, results are the same, and near to exact counts."""
    rows = [(None if i == 12 else i // 2 * 2 if i > 60 else i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("n", "word", "cell", "key", "part", "rare", "score", "known")})
    model = ngrams.Model(docs.where(ngrams.learned_from()).select("text"), shard, cell, share)
    assert shard == ngrams.SHARD or model.shards > 1
    found = sorted(ngrams.scores(docs, model).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    order = sorted(zip(base_of(rows), exact_scores(rows), strict=True), key=lambda x: (str(x[0][0]), x[0][2], x[0][5]))
    for r, (expected, exact) in zip(found, order, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[:5]
        assert r.base_score == pytest.approx(expected[5], abs=1e-6)
        assert exact - 1e-6 <= r.score <= exact + max(1.0, 0.03 * abs(exact))  # a false positive only adds


def test_scores_without_texts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = ngrams.Model(docs.where("false").select("text"))
    (row,) = ngrams.scores(docs, model).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, pytest.approx(0.0))
    assert ngrams.scores(docs.where("false"), model).count() == 0


def test_filter_finds_levels():
    rng = np.random.default_rng(0)
    grams, counts = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.geometric(0.3, 20_000) ** 3
    held = ngrams.Filter([(0, ngrams.cell_bits(grams, counts))], 1)
    zeros = np.zeros(20_000, np.int64)
    assert (held.counts(grams, zeros) >= ngrams.MIDDLE[ngrams.levels(counts)]).all()
    assert (held.counts(grams, zeros) == ngrams.MIDDLE[ngrams.levels(counts)]).mean() > 0.97
    assert (held.counts(rng.integers(0, 1 << 63, 20_000).astype(np.uint64), zeros) > 0).mean() < 0.03


def test_a_better_model_than_single_words(spark):
    """Held-out texts are likelier under the model than by single words."""
    found = ngrams.op13_lm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert found[0] > found[1] + 0.5 * found[2]


def test_a_length_of_nearly_all_rows_is_ranked_in_groups(spark):
    """A third of the rows are one row again and again, and nearly all have one length: no group is larger than its bound says."""
    rows = [(7, 0, 0, 100)] * 3000 + [(i, 0, 0, 100) for i in range(5000)] + [(i, 1, 100, 1 + i % 90) for i in range(500)] + [(None, 0, 0, 100)] * 50
    items = common.saved(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long").withColumn("_row", F.monotonically_increasing_id()), "items")
    out = packing.pack(items, 100, 500)
    assert out.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset"]
    found = out.toPandas()
    assert len(found) == len(rows) and (found.groupby("sequence_id").length.sum() <= 100).all()
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.r_[0, np.cumsum(own.length)[:-1]]).all()
    groups = items.join(spark.createDataFrame([(100, 17)], "length long, g long"), "length").groupBy(F.pmod(F.xxhash64("doc_id", "piece", "start", "_row"), F.col("g"))).count()
    assert groups.agg(F.max("count")).first()[0] < 750


def test_packing_of_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "x"), (3, "x"), (4, None)], "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_row", "_salt", "length", "piece")})
    found = packing.packed(docs).toPandas()
    assert len(found) == 5 and found.doc_id.isna().sum() == 2 and found.sequence_id.nunique() == 1
