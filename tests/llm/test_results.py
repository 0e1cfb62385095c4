"""The text operators against libraries, brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lamina.llm import bpe, chat, common, fingerprint, hnsw, html, jaccard, language, packing, tokencount, toxicity
from lamina.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = ["a", "the", "'s", " ", "  ", "\n", "é", "世界", "😀", "12", "½", "\x1c", "\xa0", "!!", "ing", "<|endoftext|>", "▁", "\t", "zz "]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def made_up(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randrange(20))) for _ in range(n)]


def test_bpe_is_tiktokens(texts):
    import tiktoken

    path, pattern = bpe.vocabulary()
    coder = bpe.byte_bpe(path, pattern)
    same = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for text in [*list(texts.values())[:80], *made_up(800), "a" * 3000, "\n" * 500]:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == same.encode_ordinary(text)
        assert coder.decode(ids) == text
        assert coder.decode(ids, chunk=1) == text


def test_bpe_is_tiktokens_for_every_letter_and_number():
    import tiktoken

    path, pattern = bpe.vocabulary()
    coder = bpe.byte_bpe(path, pattern)
    same = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for start in range(0x80, 0x40000, 64):
        text = "".join(f"{chr(c)}'s 1{chr(c)}a {chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == same.encode_ordinary(text), hex(start)


def test_bpe_query_is_the_librarys(spark, texts):
    import tiktoken

    path, pattern = bpe.vocabulary()
    same = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = QUERIES["op3_byte_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = np.array(same.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_utf8_machine_is_pythons():
    draw = random.Random(5)
    for _ in range(500):
        data = bytes(draw.choices([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xFF], k=draw.randrange(9)))
        machine = bpe.Utf8()
        assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.end() == data.decode("utf-8", "replace")


def test_token_counts_are_the_librarys(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, lengths = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.Lengths(path)
    for text in [*list(texts.values())[:80], *made_up(800, 1)]:
        assert lengths.of(text) == len(model.encode(text))


def test_table_of_frequent_pre_tokens(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    words, counts = tokencount.frequent_lengths(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = tokencount.Lengths(path, (words, counts))
    assert 10_000 < len(known.known) <= tokencount.FREQUENT and known.known["the"] == 1
    assert all(n == len(model.encode(w)) for w, n in known.known.items())
    few = tokencount.Lengths(path, tokencount.frequent_lengths(path, 10))
    assert len(few.known) == 10
    for text in [*list(texts.values())[:80], *made_up(300, 2)]:
        assert known.of(text) == few.of(text) == len(model.encode(text))
    docs = spark.createDataFrame(list(texts.items())[:50], "doc_id long, text string")
    plan = tokencount.token_counts(docs, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_token_count_query(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in QUERIES["op6_token_counts"](spark, SF).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id])) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096)


@pytest.mark.parametrize("far", [[10**12], [10**9 + k for k in range(3)] + [10**15], []])
def test_runs_of_uneven_ids(spark, far):
    ids = [*range(3000), *far, *[77] * 20, None]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = fingerprint.in_runs(docs).collect()
    own = [r for r in rows if not r.guest]
    assert sorted(r.text for r in own) == sorted(f"text {k}" for k in range(len(ids)))
    runs = {}
    for r in own:
        runs.setdefault(r.run, []).append(-1 if r.doc_id is None else r.doc_id)
    assert max(map(len, runs.values())) <= 3 * fingerprint.RUN_ROWS and len(runs) > 2
    ordered = [runs[k] for k in sorted(runs)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:], strict=False))
    guests = {r.run: r.doc_id for r in rows if r.guest}
    assert [guests[k] for k in sorted(runs)] == [max(ordered[-1]), *map(max, ordered[:-1])]


@pytest.mark.parametrize("other", [None, 3, 8])
def test_runs_of_one_id(spark, other):
    """A third of all rows, or all of them, have one id: its rows are cut by a hash of their texts."""
    docs = spark.range(3000).selectExpr("7L doc_id", "string(id) text")
    if other is not None:
        docs = docs.union(spark.createDataFrame([(other, "x"), (other, "y"), (None, "z")], "doc_id long, text string"))
    rows = fingerprint.in_runs(docs).collect()
    own = [r for r in rows if not r.guest]
    assert sorted(r.text for r in own) == sorted(r.text for r in docs.collect())
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.h)
    runs = {}
    for r in own:
        runs.setdefault(r.run, []).append(key(r))
    ordered = [runs[k] for k in sorted(runs)]
    assert max(map(len, ordered)) <= 3 * fingerprint.RUN_ROWS and len(ordered) > 3
    assert all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:], strict=False))
    guests = {r.run: key(r) for r in rows if r.guest}
    assert [guests[k] for k in sorted(runs)] == [max(ordered[-1]), *map(max, ordered[:-1])]


@pytest.mark.parametrize("module", [language, toxicity])
def test_models_at_one_address_are_told_apart(spark, module, monkeypatch):
    """As if a model that nobody holds any longer had left its address to the next one."""
    monkeypatch.setattr(module, "id", lambda x: 1, raising=False)
    keys = set()
    real = module.map_batches
    monkeypatch.setattr(module, "map_batches", lambda df, fn, schema: keys.add(next(c.cell_contents for c, n in zip(fn.__closure__, fn.__code__.co_freevars, strict=True) if n == "key")) or real(df, fn, schema))
    docs = spark.createDataFrame([(1, "some text", "en", 0)], "doc_id long, text string, lang string, toxic int")
    model = {"langs": [], "scripts": {}, "counts": {}} if module is language else {"odds": {}, "lambda": 1.0, "k": 1.0, "logistic": (-3.0, 0.0)}
    run = [language.predicted, language.labelled] if module is language else [toxicity.scored]
    for f in run * 2:
        f(docs, dict(model))
    assert len(keys) == 2 * len(run)


def xx(data, seed=42):
    """xxHash64 as a signed number: of bytes, or of numbers of 8 or 4 bytes one after another."""
    import xxhash

    for one, size in data if isinstance(data, list) else [(data, 0)]:
        seed = xxhash.xxh64_intdigest(one if not size else int(one).to_bytes(size, "little", signed=True), seed=seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_fingerprints(texts):
    """I-Match word by word: the lexicon's terms, rare others up to FEWEST, and a hash of the sorted ones of each subset."""
    import regex

    words = lambda t: {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    once = set(texts)
    counts = {}
    for t in once:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    n = len(once)
    known = {w: c for w, c in counts.items() if c >= max(2.0, fingerprint.RARE * n)}
    often = {w for w, c in known.items() if c > fingerprint.COMMON * n}

    def entries(w):
        term = xx(w.encode())
        dealt = [xx([(term, 8), (1, 4)]) % fingerprint.SUBSETS]
        if xx([(term, 8), (2, 4)]) % fingerprint.SPARSE == 0:
            dealt.append(xx([(term, 8), (3, 4)]) % fingerprint.SPARSE_SUBSETS + fingerprint.SUBSETS)
        return [(k << 56) | (term & fingerprint._LOW) for k in dealt]

    def parts(text):
        mine = [w for w in words(text) if w in known and w not in often]
        others = sorted((known.get(w, 0), xx(w.encode()), w) for w in words(text) if w not in known or w in often)
        chosen = mine + [w for *_, w in others[: max(0, fingerprint.FEWEST - len(mine))]]
        all_ = sorted(e for w in chosen for e in entries(w))
        out = []
        for k in range(fingerprint.SUBSETS + fingerprint.SPARSE_SUBSETS):
            some = " ".join(str(e) for e in all_ if e >> 56 == k)
            out.append(xx(some.encode()) % 65535 + 1 if some else 0)
        return out

    return parts


def alike(p, q, same):
    either = sum(x > 0 or y > 0 for x, y in zip(p, q))
    return sum(x == y > 0 for x, y in zip(p, q)) / either if either else float(same)


def test_fingerprint_query_is_brute_forces(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op1_imatch"](spark, SF).collect()}
    parts = brute_fingerprints(list(texts.values()))
    order = sorted(texts, reverse=True)
    mine = {i: parts(t) for i, t in texts.items()}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        text, h = texts[i], len(texts[i]) // 2
        edited = text[: len(text) - h] + texts[j][:h]
        q = parts(edited)
        if any(mine[i]):
            assert rows[i].fingerprint == "".join(f"{x:04x}" for x in mine[i])
        if any(q):
            assert rows[i].edited_fingerprint == "".join(f"{x:04x}" for x in q)
        assert rows[i].n_chars == len(text)
        assert rows[i].near_edited == pytest.approx(alike(mine[i], q, text == edited))
        assert rows[i].near_next == pytest.approx(alike(mine[i], mine[j], text == texts[j]))


def near_copies(words, n, seed):
    """n texts of words that differ in one character."""
    out = []
    for k in range(n):
        mine = list(words)
        at = random.Random(seed + k).randrange(len(mine))
        mine[at] = mine[at][:2] + "xyzvwq"[k % 6] + str(k)
        out.append(" ".join(mine))
    return out


def test_fingerprints_of_hot_near_copies(spark):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdefghij", k=5)) for _ in range(500)]
    others = [" ".join(draw.choices(vocabulary, k=60)) for _ in range(80)]
    hot = near_copies(["".join(draw.choices("klmnop", k=6)) for _ in range(80)], 40, 7)
    copies = ["the very same " + others[0]] * 30
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(others + hot + copies)], "doc_id long, text string")
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert all(len(r.fingerprint) == 4 * (fingerprint.SUBSETS + fingerprint.SPARSE_SUBSETS) for r in rows.values())
    assert min(rows[i].near_next for i in range(81, 120)) > 0.7
    assert max(rows[i].near_next for i in range(1, 81)) < 0.5
    assert {rows[i].near_next for i in range(121, 150)} == {1.0} and len({rows[i].fingerprint for i in range(120, 150)}) == 1
    # A copy's terms count once: the other texts' fingerprints are those without the copies.
    fewer = {r.doc_id: r for r in fingerprint.fingerprints(docs.where("doc_id < 121")).collect()}
    assert all(fewer[i].fingerprint == rows[i].fingerprint for i in range(121))


def test_fingerprints_of_rare_terms(spark):
    rare = near_copies([f"rare{k}" for k in range(60)], 2, 5)
    docs = spark.range(6000).selectExpr("id doc_id", "concat_ws(' ', 'common', id % 7, id % 11, id % 13) text").union(spark.createDataFrame([(6000 + i, t) for i, t in enumerate(rare)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).where("doc_id >= 6000").collect()}
    assert not any(r.fingerprint.startswith("text-") for r in rows.values())
    assert rows[6001].near_next > 0.8 and rows[6000].near_next < 0.1


def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op1_imatch"](spark, SF).collect()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        text, h = texts[i], len(texts[i]) // 2
        assert rows[i].edited_sha256 == hashlib.sha256((text[: len(text) - h] + texts[j][:h]).encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)


def test_chat_round_trip(spark):
    for text in made_up(300, 2) + ["<|", "\\", "\\<|im_end|>", "<\\|"]:
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    rows[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    out = {r.conv_id: r for r in QUERIES["op2_chat_format"](spark, SF).collect()}
    assert out.keys() == rows.keys()
    for k, turns in rows.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert out[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (out[k].loss_chars, out[k].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_content_parts():
    parts = [{"kind": "text", "text": "see <|image_0|>"}, {"kind": "image", "ref": "a", "width": 57, "height": 28}, {"kind": "document", "ref": "b", "pages": 2}, {"kind": "audio", "ref": "c", "seconds": 0.5}]
    out, begin, end, attached = chat.format_turn("assistant", parts)
    assert out[begin:end] == "see <\\|image_0|><|image_0|><|document_1|><|audio_2|>"
    assert [(a["ref"], a["tokens"]) for a in attached] == [("a", 3), ("b", 1024), ("c", 13)]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"kind": "video"}])


def test_nearest_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    found = {}
    for r in QUERIES["op4_nearest_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, []).append(r)
    for q, near in found.items():
        scores = points @ points[ids == q][0]
        best = [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits, total = hits + len({r.vec_id for r in near} & set(best)), total + len(best)
        near.sort(key=lambda r: r["rank"])
        assert all(abs(r.score - scores[ids == r.vec_id][0]) < 1e-12 for r in near)
        assert near == sorted(near, key=lambda r: (-r.score, r.vec_id))
    assert hits >= 0.95 * total


def made_vectors(n, dim=24, seed=3):
    """Clusters of unlike sizes, vectors of unlike norms, and one vector out of ten without a cluster."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(60, dim))
    of = np.minimum(draw.geometric(0.05, n) - 1, 59)
    points = centres[of] + 0.35 * draw.normal(size=(n, dim))
    points[::10] = draw.normal(size=(len(points[::10]), dim))
    return points * draw.uniform(0.7, 1.4, (n, 1))


def test_recall_of_one_graph():
    """A shard of many times the breadth: the graph is searched, not scanned."""
    points = made_vectors(20_000)
    norm = float((points * points).sum(1).max())
    graph = hnsw.Graph(hnsw._augmented(points, norm))
    hits = 0
    for q in points[::199]:
        found = graph.search(np.append(q, 0.0).astype(np.float32), hnsw.SEARCH_BREADTH)
        hits += len(set(np.argsort(-(points @ q))[:20].tolist()) & set(sorted(found, key=lambda x: -(points[x] @ q))[:20]))
    assert hits >= 0.95 * 20 * 101


def test_recall_over_cells(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "CELL_NODES", 2000)
    monkeypatch.setattr(hnsw, "SHARD_NODES", 2500)
    points = made_vectors(20_000).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in hnsw.nearest(table, "vec_id % 99 = 0").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, near in found.items():
        scores = points @ points[q]
        order = [i for i in np.lexsort((np.arange(len(points)), -scores)) if i != q][:20]
        assert len(near) == 20 and all(abs(s - scores[i]) < 1e-9 for _, i, s in near)
        hits += len({i for _, i, _ in near} & set(order))
    assert len(found) == 203 and hits >= 0.95 * 20 * 203


def test_recall_without_clusters(spark, monkeypatch):
    """Independent components, more of them than any graph of few links suits: one cell of several shards of the usual size."""
    monkeypatch.setattr(hnsw, "CELL_NODES", 20_000)
    points = np.random.default_rng(7).normal(size=(12_500, 64)).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in hnsw.nearest(table, "vec_id % 125 = 0").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, near in found.items():
        order = np.argsort(-(points @ points[q]), kind="stable")
        hits += len(near & set(order[order != q][:20].tolist()))
    assert len(found) == 100 and hits >= 0.92 * 20 * 100, hits


def brute_components(texts):
    sets = {i: frozenset(jaccard.shingles(t).tolist()) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("tile", "few", "settled"), [(1024, 2_000_000, 0.5), (8, 1, 0.0)])
def test_near_duplicates_are_brute_forces(spark, monkeypatch, tile, few, settled):
    """As it is; and with blocks of few documents, few pairs of one n-gram, shuffled joins and tiles right after the first pivots."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", few)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(jaccard, "PAIRED", 256 if tile > 100 else 4)
    monkeypatch.setattr(jaccard, "SETTLED", settled)
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [draw.choices(vocabulary, k=60) for _ in range(6)]
    passage = draw.choices(vocabulary, k=30)
    texts = {}
    for i in range(160):
        words = list(base[i % 6]) if i % 3 else draw.choices(vocabulary, k=draw.randrange(1, 50))
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts[i] = " ".join(words + passage * (i % 5 == 0))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = jaccard.near_duplicates(docs).collect()
    roots, sizes = brute_components(texts)
    assert {r.doc_id: r.component_id for r in out} == roots
    assert {r.doc_id: r.n_shingles for r in out} == sizes
    assert len(set(roots.values())) < len(roots)


def test_partial_overlaps_are_counted_by_fragment(spark):
    draw = random.Random(2)
    texts = {i: " ".join(draw.choices("abcdefgh", k=draw.randint(1, 40))) for i in range(12)}
    sets = {i: jaccard.shingles(t, 2) for i, t in texts.items()}
    order = (np.sort(np.concatenate([sets[0], sets[1]]))[:9], None, None)
    for x in sets.values():
        parts = jaccard.segments(x, order)
        assert len(parts) == jaccard.FRAGMENTS and sorted(np.concatenate(parts).tolist()) == sorted(x.tolist())
        assert set(parts[-1].tolist()) == set(x.tolist()) & set(order[0].tolist())
    for i, j in itertools.combinations(sets, 2):
        partial = [np.intersect1d(a, b).size for a, b in zip(jaccard.segments(sets[i], order), jaccard.segments(sets[j], order))]
        assert sum(partial) == np.intersect1d(sets[i], sets[j]).size


def test_near_duplicates_query(spark, texts):
    roots, _ = brute_components(texts)
    assert {r.doc_id: r.component_id for r in QUERIES["op5_ngram_jaccard"](spark, SF).collect()} == roots


def test_viterbi_is_brute_forces():
    draw = np.random.default_rng(0)
    for _ in range(60):
        n, k, switch = int(draw.integers(1, 7)), 3, float(draw.choice([1.0, 3.0, 8.0]))
        scores = -draw.random((n, k)) * 10 * (draw.random((n, k)) < 0.6)
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert abs(value(language.viterbi(scores, switch).tolist()) - max(map(value, itertools.product(range(k), repeat=n)))) < 1e-9


def test_language_held_out(spark):
    rows = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_spans():
    words = {"aa": "the and of", "bb": "der die und"}
    counts = {k: {} for k in words}
    for k, v in words.items():
        for w in v.split() * 20:
            for g in language.grams_of(w):
                counts[k][g] = counts[k].get(g, 0) + 1
    scorer = language.Scorer({"langs": ["aa", "bb"], "scripts": {k: {"latin": 99} for k in words}, "counts": counts})
    text = "the and of the of and der und die und der die"
    assert [(s["first"], s["last"], s["lang"]) for s in scorer.spans(text)] == [(0, 5, "aa"), (6, 11, "bb")]
    assert scorer.predict("123 ... !") == ("und", 0.0)


def test_a_long_word_changes_no_other_word():
    counts = {k: {g: 20 for g in language.grams_of(v)} for k, v in {"aa": "abcdefgh", "bb": "stuvwxyz"}.items()}
    scorer = language.Scorer({"langs": ["aa", "bb"], "scripts": {k: {"latin": 99} for k in counts}, "counts": counts})
    short, long = "abcdefgh" * 6, "stuvwxyz" * 9
    alone = scorer.matrix([short])
    assert (scorer.matrix([short, long])[0] == alone[0]).all()
    assert [(s["first"], s["last"], s["lang"]) for s in scorer.spans(f"{short} {short} {long} {long}")] == [(0, 1, "aa"), (2, 3, "bb")]
    assert scorer.predict(long * 1000 + " " + short) == ("bb", pytest.approx(72000 / 72048))


def test_rare_languages_keep_their_rows(spark):
    rows = [(i, "common words of it", "aa") for i in range(500)] + [(500 + i, "xyzzy", "rare") for i in range(3)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40)
    assert model["langs"] == ["aa", "rare"] and model["counts"]["rare"]["xyz"] == 3
    assert 0 < model["counts"]["aa"]["com"] < 60


def test_language_query_is_brute_forces(spark, texts):
    """The query's rows, from the model that it learns, by an exhaustive search over labels of each text's first words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = language.Scorer(language.learn(docs.where(language.held_out() == False)))  # noqa: E712
    found = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    k = len(scorer.langs)
    for doc_id in sorted(texts)[:60]:
        words = (texts[doc_id] or "").split()
        scores = scorer.matrix(words)[:, :-1].astype(float) if words else np.zeros((0, k))
        best = scores[0] if words else np.zeros(k)  # of all labellings that end in a label, by all predecessors
        came = []
        for row in scores[1:]:
            all_ = best[:, None] - language.SWITCH * (1 - np.eye(k)) + row[None, :]
            came.append(all_.argmax(0))
            best = all_.max(0)
        at = [int(best.argmax())] if words else []
        for c in reversed(came):
            at.append(int(c[at[-1]]))
        weight = np.zeros(k)
        for label, word in zip(reversed(at), words, strict=True):
            weight[label] += len(language.letters_of(word))
        r = found[doc_id]
        if not weight.sum():
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == scorer.langs[int(weight.argmax())] and r.score == pytest.approx(weight.max() / weight.sum())


def test_maximal_segments_are_brute_forces():
    draw = random.Random(3)

    def brute(scores):  # the best segment, then the same on both sides of it
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return brute(scores[:i]) + [(i, j - 1, best[0])] + [(a + j, b + j, s) for a, b, s in brute(scores[j:])]

    for _ in range(400):
        scores = [draw.choice([-0.26, -0.75, 0.3, 1.1]) for _ in range(draw.randrange(16))]
        found = toxicity.maximal_segments(np.array(scores))
        assert [x[:2] for x in found] == [x[:2] for x in brute(scores)]
        assert [x[2] for x in found] == pytest.approx([x[2] for x in brute(scores)])


def test_maximal_segments_take_linear_time():
    for one in ([0.5, -0.6], [0.5, -0.4]):
        scores = np.array(one * 200_000)
        began = time.time()
        found = toxicity.maximal_segments(scores)
        assert len(found) == (200_000 if sum(one) < 0 else 1) and time.time() - began < 10


def test_extreme_values_are_fitted():
    draw = np.random.default_rng(1)
    n = draw.integers(5, 3000, 20_000).astype(float)
    best = (np.log(0.02 * n) - np.log(-np.log(draw.random(len(n))))) / 1.7
    rate, k = toxicity.extreme_value_fit(n, best)
    assert rate == pytest.approx(1.7, rel=0.03) and k == pytest.approx(0.02, rel=0.15)


def test_toxicity_query_is_brute_forces(spark, texts):
    """The query's scores, from the model that it learns, with every stretch of words tried."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(toxicity.training_rows(docs, labels))
    known = lambda w: next((model["odds"][f] for f in toxicity.features_of(toxicity.normal(w)) if f in model["odds"]), 0.0)

    def brute(scores):
        if len(scores) == 0 or max(scores) <= 0:
            return []
        sums = np.concatenate(([0.0], np.cumsum(scores)))
        gain = sums[None, :] - sums[:, None]
        i, j = np.unravel_index(np.triu(gain, 1).argmax(), gain.shape)
        return [*brute(scores[:i]), gain[i, j], *brute(scores[j:])]

    found = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    assert sorted(found) == sorted(texts)
    for doc_id, text in texts.items():
        words = (text or "").split()
        if len(words) < 1500:
            chance = np.log(model["k"] * max(1, len(words)))
            evidence = sum(max(0.0, model["lambda"] * s - chance) for s in brute([known(w) - toxicity.DRIFT for w in words]))
            a, b = model["logistic"]
            p = 1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence), -30, 30)))
            assert found[doc_id].score == pytest.approx(p, rel=1e-3, abs=1e-4)
            assert found[doc_id].predicted == (found[doc_id].score >= 0.3)
            assert found[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_toxicity"](spark, d).collect() if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert hit > 0.83 * sum(labels[r.doc_id] for r in rows) and hit > 0.88 * sum(r.predicted for r in rows)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op8_best_fit_packing"](spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    totals = rows.groupby("sequence_id").length.sum()
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all() and totals.max() <= 2048
    assert len(totals) <= 1.02 * np.ceil(rows.length.sum() / 2048) + 1
    for doc_id, mine in rows.groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        mine = mine.sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[1:] == 2048).all() and list(mine.piece) == list(range(len(mine)))
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == list(mine.ids_crc32)


def in_ranges(runs, capacity=100, ranges=5):
    """sweep() of each range of sizes, and of what they leave."""
    placed, left = [], []
    for k in range(ranges):
        some = packing.sweep([r for r in runs if r[1] * ranges // (capacity + 1) == k])
        placed += some[0]
        left += some[1]
    more = packing.sweep(left)
    return placed + more[0], more[1]


def test_packing_plan():
    draw = random.Random(1)
    for _ in range(50):
        counts = {draw.randint(1, 100): draw.randint(1, 30) for _ in range(draw.randint(0, 30))}
        used, seen = {}, {}
        runs = packing.plan(counts, 100)
        assert sorted(packing.plan(counts, 100, in_ranges)) == sorted(runs)  # ranges give what one sweep over all gives
        for length, first, each, gap, sequence, n in runs:
            seen.setdefault(length, []).extend(range(first, first + each * n))
            for k in range(n):
                used.setdefault(sequence + k, []).extend((100 - gap + e * length, length) for e in range(each))
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(v)) for k, v in counts.items()}
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 100
        assert len(used) <= 1.25 * sum(k * v for k, v in counts.items()) / 100 + 3 or any(k > 50 for k in counts)


def test_a_round_is_a_sweep(spark):
    draw = random.Random(8)
    runs = [(draw.randrange(2), draw.randint(1, 60), 1000 * k, draw.randint(1, 9)) for k in range(60)]
    a, b = packing.swept(spark, runs), packing.sweep(runs)
    assert sorted(a[0]) == sorted(b[0]) and sorted(a[1]) == sorted(b[1])


PAGE = """<html><body><header><h1>Site</h1><a href=x>home</a></header><div id="cookie-notice">We use cookies to make this site work, and to show adverts. Do you accept?</div>
<div class="sidebar"><p>Some long text of a sidebar that goes on for quite a while, with more words than one would think possible.</p></div><main><article><header><h1>Title &amp; more</h1></header>
<p>First   para.<aside>Read also: this</aside><p>Second<form><label>Mail</label><input></form></p><ul><li>one</li><li>two</li></ul><div class="ad">Buy!</div><script>if (a < b) "</p>"</script></article>
<section id="comments"><article class="comment"><p>I think that this is a great article, with a long comment that goes on and on and on.</p></article></section></main><footer>(c)</footer>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\nFirst para.\nSecond\none\ntwo"


def test_header_of_an_article():
    page = '<body><div class="page-header">Site name and a slogan</div><article><div class="post-header"><h1>Title</h1></div><p>Text of the article.</p><div class="share-box">Share this</div></article></body>'
    assert html.main_text(page) == "Title\nText of the article."


LINES = [f"Paragraph {k} of the page, which has more than a hundred characters and no link, so that nobody would take it for a menu." for k in range(3)]


@pytest.mark.parametrize(
    "outer",
    [
        '<body class="right-sidebar">{}</body>', '<body class="has-header"><main>{}</main></body>', '<html class="no-ads"><body><div id="page" class="no-sidebar">{}</div></body></html>', '<body><article class="post comments-open">{}</article></body>',
        '<body><div class="layout-sidebar"><article class="share-enabled">{}</article></div></body>', '<body><div class="comments-enabled"><main role="main">{}</main></div></body>', '<body><div class="comments-open"><div class="content">{}</div></div></body>',
        '<body><main class="with-search"><div class="header-visible">{}</div></main></body>', '<body class="overlay"><div><form action="x" class="search"><input></form></div><div class="banner-on"><article>{}</article></div></body>',
    ],
)
def test_words_of_a_wrapper(outer):
    assert html.main_text(outer.format("".join(f"<p>{x}</p>" for x in LINES))) == "\n".join(LINES)


def test_articles_in_wrappers_that_share_the_page():
    page = "<body>" + "".join(f'<div class="item-header"><article><p>{x}</p></article></div>' for x in LINES) + "</body>"
    assert html.main_text(page) == "\n".join(LINES)


def test_boilerplate_stays_longer_than_the_article():
    much = "".join(f"<p>{x}</p>" for x in LINES)
    for other in ('<ol class="comment-list"><li><article class="comment-body">{}</article></li></ol>', '<div class="related"><article class="card">{}</article></div>', '<article class="comment">{}</article>', '<section id="comments">{}</section>'):
        for page in (f"<body><article><p>{LINES[0]}</p></article>{other}</body>", f"<body><main><article><p>{LINES[0]}</p>{other}</article></main></body>"):
            assert html.main_text(page.format(much)) == LINES[0], page
    assert html.main_text(f'<body><div class="cookie-consent">{much}</div><article><p>{LINES[0]} {LINES[1]}</p></article></body>') == f"{LINES[0]} {LINES[1]}"


@pytest.mark.parametrize("empty", ['<svg class="icon"/>', "<svg data-x='a > b' />", "<math/>", "<video-player src=x></video-player>", "<option-list>", "<svg-icon/>", "<title-bar></title-bar>"])
def test_elements_that_drop_nothing(empty):
    assert html.main_text(f"<body><p>{LINES[0]}</p>{empty}<p>{LINES[1]}</p></body>") == f"{LINES[0]}\n{LINES[1]}"


def test_dropped_elements_stay_dropped():
    for dropped in ("<svg><text>no</text></svg>", '<svg width="1" ><path d="x"/><text>no</text></svg>', "<script>no</script>", "<script\nsrc=x/>no</script>", "<math><mi>no</mi></math>", "<STYLE type=x>no</STYLE >", "<title>no</title>"):
        assert html.main_text(f"<body><p>{LINES[0]}</p>{dropped}<p>{LINES[1]}</p></body>") == f"{LINES[0]}\n{LINES[1]}"


def test_minimum_cut_is_brute_forces():
    draw = random.Random(4)
    for _ in range(100):
        n = draw.randint(1, 6)
        odds = [draw.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, draw.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]
        cost = lambda keep: sum(max(x, 0) if k else max(-x, 0) for x, k in zip(odds, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        assert cost(html.minimum_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_pages_query_gives_the_articles(spark):
    """The pages of the tables hold one article each: its paragraphs and nothing else are the text."""
    rows = {r.page_id: r for r in QUERIES["op9_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert sorted(rows) == sorted(r.page_id for r in pages)
    import re
    from html import unescape

    changed = 0
    for page in pages:
        inside = re.search(r"<article[^>]*>(.*)</article>", page.html, re.S)
        parts = re.split(r"</?(?:p|h1|div|article|ul|li|blockquote|pre|section)\b[^>]*>", re.sub(r"<script.*?</script>|<!--.*?-->|<(aside|div class=\"ad\")[^>]*>.*?</(aside|div)>", "", inside[1], flags=re.S))
        lines = [" ".join(unescape(re.sub(r"<br[^>]*>", " ", x)).split()) for x in parts]
        lines = [" ".join(re.sub(r"<[^>]*>", "", x).split()) for x in lines]
        assert rows[page.page_id].text == "\n".join(x for x in lines if x) and rows[page.page_id].n_chars == len(rows[page.page_id].text)
        blocks, keep = html.labelled(page.html)
        changed += sum((b.odds < 0) != k for b, k in zip(blocks, keep, strict=True))
    assert changed > 0  # what a block's text says isn't the last word


def plain_cut(odds, edges):
    """The cost of a minimum cut, as a maximum flow by plain augmenting paths."""
    n = len(odds)
    room = {}
    for i, x in enumerate(odds):
        room[("s", i) if x < 0 else (i, "t")] = abs(x)
    for a, b, c in edges:
        room[a, b] = room.get((a, b), 0.0) + c
        room[b, a] = room.get((b, a), 0.0) + c
    near = {}
    for a, b in list(room):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = 0.0
    while True:
        came, queue = {"s": None}, ["s"]
        for x in queue:
            for y in near.get(x, ()):
                if y not in came and room.get((x, y), 0.0) > 1e-9:
                    came[y] = x
                    queue.append(y)
        if "t" not in came:
            return total
        path, x = [], "t"
        while came[x] is not None:
            path.append((came[x], x))
            x = came[x]
        flow = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= flow
            room[b, a] = room.get((b, a), 0.0) + flow
        total += flow


def test_pages_query_is_brute_forces(spark):
    """The query's labels cost what a minimum cut costs, found in another way, and its texts are those labels'."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html.learn(pages)
    rows = {r.page_id: r.text for r in QUERIES["op9_html_extraction"](spark, SF).collect()}
    for page in pages.collect():
        blocks, elements = html.blocks_of(page.html)
        html.classify(blocks, elements, weights)
        odds, edges = html.network(blocks, elements)
        keep = html.minimum_cut(odds, edges)
        cost = sum(max(x, 0) if k else max(-x, 0) for x, k in zip(odds, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])
        assert cost == pytest.approx(plain_cut(odds, edges))
        assert rows[page.page_id] == "\n".join(b.text for b, k in zip(blocks, keep) if k)


def test_the_classifier_is_fitted():
    plain, page = html.PLAIN_WEIGHTS, "<article><p>{}</p><p>Short.</p></article><nav><ul><li><a href=x>home</a></li></ul></nav>".format("Many words here. " * 10)
    assert [b.says for b in html.blocks_of(page)[0]] == [("", "long", "paragraph", "sentence"), ("", "short", "paragraph", "sentence"), ("", "short", "links", "item")]
    assert plain["item"] == 0.0


def test_classifier_weights(spark):
    page = "<article><p>{}</p><p>Short.</p></article><nav><ul><li><a href=x>home</a></li><li>more</li></ul></nav>".format("Many words here. " * 10)
    learnt = html.learn(spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string"))
    assert learnt["item"] > 0.5 > 0 > learnt["sentence"] and learnt["paragraph"] < html.PLAIN_WEIGHTS["paragraph"]
    assert html.learn(spark.createDataFrame([(1, "<p>one</p>")], "page_id long, html string")) == html.PLAIN_WEIGHTS


@pytest.mark.parametrize(
    "page",
    ["<body>" + "".join(f"<p>Words of a paragraph number {i} which has more than one hundred characters in all, if they are counted.</p><h3>Short {i}</h3>" for i in range(8000)), "<a " * 80_000, '<a b="> <a b=">x" ' * 40_000, "<div>text " * 30_000, "<div></x>text " * 30_000, "<!" * 300_000, "<script>" * 50_000, "<!--" * 100_000],
    ids=["paragraphs", "open", "quotes", "deep", "unmatched", "bang", "script", "comments"],
)
def test_hard_pages_take_linear_time(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 20


def test_pipeline_is_brute_forces(spark, texts):
    """run() against its stages done text by text: what stays after each, and the packing of just that."""
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = language.Scorer(language.learn(docs.where(language.held_out() == False)))  # noqa: E712
    said = {i: scorer.predict(t) for i, t in texts.items()}
    stay = {i for i, (lang, share) in said.items() if lang != "und" and share >= corpus_pipeline.LANGUAGE_LEAST}
    left = docs.where(docs.doc_id.isin(sorted(stay)))
    toxic = toxicity.Scorer(toxicity.learn(toxicity.training_rows(left, labels)))
    stay = {i for i in stay if toxic.probability(toxic.evidence(texts[i])) < toxicity.THRESHOLD}
    roots, _ = brute_components({i: texts[i] for i in stay})
    stay = {i for i in stay if roots[i] == i}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows.doc_id) == stay and len(stay) < len(texts)
    for doc_id, mine in rows.groupby("doc_id"):
        ids = np.array([*library.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert mine.length.sum() == len(ids)
        assert sorted(mine.ids_crc32) == sorted(zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length))
    assert rows.groupby("sequence_id").length.sum().max() <= 2048 and rows.sequence_id.nunique() <= 1.02 * np.ceil(rows.length.sum() / 2048) + 1
