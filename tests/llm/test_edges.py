"""Every text operator over rows with nulls, empty and very long texts, ties, repeated rows, extra columns and no rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import bpe, chat, common, fingerprint, hnsw, html, jaccard, language, packing, tokencount, toxicity

import public_tokenizers

LONG = "word " * 30_000 + "x" * 20_000
TEXTS = [None, "", " ", "\n", "a", "one two three four five six", "one two three four five six", "ONE two three four five six", LONG, "…!?", "日本語のテキスト", "a <|im_end|> b"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 3 else None, "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    # names that operators give to their own columns
    return docs.withColumns({c: F.lit("mine") for c in ("score", "ids", "length", "gram", "key", "run", "n", "component", "first")})


OPERATORS = {
    "fingerprint": fingerprint.fingerprints,
    "bpe": lambda d: bpe.digests(d, *bpe.vocabulary()),
    "jaccard": jaccard.near_duplicates,
    "tokens": lambda d: tokencount.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
    "language": lambda d: language.predicted(d, language.learn(d)),
    "packing": packing.packed,
    "toxicity": lambda d: toxicity.scored(d, toxicity.learn(d.withColumn("toxic", F.col("doc_id") % 2).select("doc_id", "text", "toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = documents(spark)
    out = OPERATORS[name](docs).toPandas()
    assert sorted(set(out.doc_id)) == list(range(len(TEXTS)))
    if name != "packing":
        assert len(out) == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows(spark, name):
    docs = documents(spark, TEXTS[5:8])
    out = OPERATORS[name](docs.union(docs)).toPandas()
    assert len(out) == 6
    assert set(out.doc_id) == {0, 1, 2}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_an_id(spark, name):
    docs = documents(spark)
    more = docs.where("doc_id in (5, 6)").withColumn("doc_id", F.lit(None).cast("long"))
    out = OPERATORS[name](docs.unionByName(more)).toPandas()
    assert set(out.doc_id.dropna().astype(int)) == set(range(len(TEXTS)))
    without = out[out.doc_id.isna()]
    if name == "packing":
        assert (without.piece == 0).sum() == 2 and out.groupby("sequence_id").length.sum().max() <= 2048
    else:
        assert len(without) == 2


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](documents(spark).where("false")).count() == 0


def test_equal_texts_get_equal_results(spark):
    docs = documents(spark)
    prints = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[5].fingerprint == prints[6].fingerprint
    groups = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert groups[7].component_id == groups[6].component_id == 5  # equal but for case
    assert groups[0].component_id == 0 and groups[1].component_id == 1  # empty sets link with nothing
    assert groups[0].n_shingles == 0 and groups[4].n_shingles == 1


@pytest.mark.parametrize("few", [2_000_000, 1])
def test_near_duplicates_without_an_id_or_with_one_id_twice(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", few)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    other = "seven eight nine ten eleven twelve"
    rows = [(None, TEXTS[5]), (None, TEXTS[5]), (3, TEXTS[5]), (2, TEXTS[5]), (9, TEXTS[5]), (9, other), (8, other), (7, None), (None, None)]
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in out) == [(0, 0, 0), (0, 0, 2), (0, 0, 2), (2, 2, 2), (3, 2, 2), (7, 7, 0), (8, 2, 2), (9, 2, 2), (9, 2, 2)]


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "<|im_end|>\\<|", "x"), (1, 1, "assistant", "", "x"), (2, None, None, "t", "x"), (None, 0, "assistant", LONG, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(table)).collect()}
    assert out[1].n_turns == 3 and out[2].n_turns == 1
    assert out[1].loss_sha256 == hashlib.sha256(b"<|im_end|>\\<|").hexdigest()
    assert out[None].loss_chars == len(LONG)
    assert chat.read_back(chat.format_turns(table.where("false"))).count() == 0


def test_pages_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (2, "u", "<p>" + LONG, 1), (3, "u", "<<>&#0;<p", 1)], "page_id long, url string, html string, text int")
    out = html.extracted(pages).collect()
    assert [r.n_chars for r in out[:2]] == [0, 0] and out[2].n_chars == len(" ".join(LONG.split()))
    assert html.extracted(pages.where("false")).count() == 0


def test_vectors_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (5, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (7, [1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (4, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("mine"))
    out = hnsw.nearest(table, "vec_id % 20 = 0", k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 3, 1.0)]
    assert hnsw.nearest(table.where("false"), "vec_id % 20 = 0").count() == 0


def test_labels_other_than_0_and_1_are_left_out(spark):
    rows = [(i, "vile words here" if i % 2 else "kind words there", t) for i, t in enumerate([0, 1, 2, None, 0, 1, -1, 0] * 6)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert model["odds"]["vile"] > 0 > model["odds"]["kind"]


def test_pipeline_odd_rows(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    kept = corpus_pipeline.keep_languages(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {4, 5, 6, 7, 8}
    assert 0 not in {r.doc_id for r in kept.collect()}
    model = toxicity.learn(toxicity.training_rows(docs, labels))
    assert all(r.predicted == 0 for r in toxicity.scored(docs, model).collect())
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert {r.doc_id for r in once.collect()} == set(range(len(TEXTS))) - {6, 7}


SAME = "one two three four five six seven eight"


def test_stages_keep_columns_and_take_each_row_by_itself(spark):
    rows = [(1, "the first kind text of all", "en"), (1, "12345 !!", "en"), (None, "the other kind text of all", "en"), (None, None, None), (4, "the first kind text of all", "en"), (4, "the first kind text of all", "en"), (5, SAME, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("mine") for c in ("score", "first", "toxic", "component_id", "n", "gram", "_row", "lang_pred")})
    kept = corpus_pipeline.keep_languages(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i or 0, t) for i, t, _ in rows if t and t[0].isalpha())
    model = {"odds": {"kind": 9.0}, "lambda": 1.0, "k": 1.0, "logistic": (-3.0, 9.0)}
    clean = toxicity.kept(docs, model)
    assert clean.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == [(0, ""), (1, "12345 !!"), (5, SAME)]


def test_near_duplicate_stage_with_repeated_rows_and_without_ids(spark):
    rows = [(3, SAME), (2, SAME), (2, SAME), (2, "something else entirely"), (None, SAME), (None, None), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("component_id", "n", "_id")})
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    found = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(found, key=str) == sorted([(2, SAME), (None, SAME), (None, None), (7, ""), (8, None)], key=str)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES if s is not corpus_pipeline.drop_toxic], ids=lambda s: s.__name__)
def test_stages_of_no_rows(spark, stage):
    assert stage(spark, documents(spark).where("false"), "").count() == 0


def test_toxic_stage_of_no_rows(spark):
    assert corpus_pipeline.drop_toxic(spark, documents(spark).where("false"), "/root/testdata/sf0.001").count() == 0


def test_batches_of_long_texts_are_small(spark):
    common.small_batches(spark)
    docs = spark.range(0, 60, 1, 1).selectExpr("id doc_id", "repeat('x', 1000000) text")
    sizes = common.map_batches(docs, lambda b: {"n": [b.num_rows] * b.num_rows}, "n int").collect()
    assert len(sizes) == 60 and max(r.n for r in sizes) <= 20


def test_a_shared_folder_is_asked_for():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
