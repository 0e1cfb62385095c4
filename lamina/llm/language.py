"""Language identification of mixed-language text.

Script ranges narrow the languages that a word can have; character n-grams score it in each of these; a Viterbi pass with
a penalty for each switch labels spans of words. The n-grams are counted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import struct
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BoundedCache, filtered_batches, held_out, map_batches, table

#: Labelled rows that the scores are learned from at most, shared evenly by the languages, and n-grams kept of each language
#: at most, those seen most.
SAMPLE, GRAMS = 20_000, 100_000
#: What a change of language costs, in units of log probability; the most that so many letters in a row can say against a language.
SWITCH, WORD_MOST, WORD_LETTERS = 8.0, 6.0, 32
#: The share of a language's letters from which on it is held to be written in a script.
SCRIPT_SHARE = 0.01
KEPT = 300_000

#: First code points of script ranges (fixed values of Unicode), "" between them; letters elsewhere count as "other".
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB07, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"),
]
_STARTS = [a for a, _ in SCRIPTS]


def script_of(char: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(char)) - 1][1]


def letters_of(word: str) -> str:
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    return word.lower() if word.isalpha() else "".join([c for c in word.lower() if c.isalpha()])


def grams_of(letters: str) -> list[str]:
    marked = f"^{letters}$"
    return [marked[i : i + 3] for i in range(len(letters))]


def sample_of_each(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` of the rows (doc_id, text, lang) at most, the same number of each language where there are so many:
    a rare language keeps all its rows beside a frequent one."""
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    each = sample / max(1, len(counts))
    shares = rows.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / r["count"]) * (1 << 30))) for r in counts], "lang string, share long")
    return rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share")).drop("share")


def learn(rows: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> dict:
    """The model from rows (doc_id, text, lang) whose lang isn't null: counts of n-grams and of scripts by language.

    Null texts add nothing, repeated rows count as often as they occur, other columns aren't read; without a row with a
    language the model has none. Of n-grams seen equally often the first ones are kept.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.update((lang, w) for w in (text or "").split())
            if len(words) > 200_000:
                yield emitted(words)
                words = Counter()
        yield emitted(words)

    def emitted(words: Counter) -> pa.RecordBatch:
        counts: Counter = Counter()
        for (lang, word), n in words.items():
            letters = letters_of(word)
            if letters:
                for g in grams_of(letters):
                    counts[lang, g] += n
                for c in letters:
                    counts[lang, "\n" + script_of(c)] += n
        keys = list(counts)
        return pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "gram": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([counts[k] for k in keys], pa.int64())})

    taken = sample_of_each(rows.where("lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang")), sample).select("text", "lang")
    summed = taken.mapInArrow(counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("gram").startswith("\n").desc(), F.desc("n"), "gram")
    scripts, counts = {}, {}
    for r in summed.withColumn("at", F.row_number().over(best)).where(F.col("at") <= grams).orderBy("lang", "at").collect():  # bounded by the sample, and by grams for each language
        (scripts if r.gram[0] == "\n" else counts).setdefault(r.lang, {})[r.gram.strip("\n")] = r.n
    return {"langs": sorted(scripts), "scripts": scripts, "counts": counts}


class Scorer:
    """Scores of words and labels of texts by a model from learn()."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        counts = [model["counts"].get(lang, {}) for lang in self.langs]
        vocabulary = set().union(*counts) if counts else set()
        self.logs: dict[str, tuple[float, ...]] = {}
        totals = [sum(c.values()) + 0.5 * len(vocabulary) + 1 for c in counts]
        for g in vocabulary:
            self.logs[g] = tuple(math.log((c.get(g, 0) + 0.5) / t) for c, t in zip(counts, totals, strict=True))
        self.unseen = tuple(math.log(0.5 / t) for t in totals)
        self.script_langs: dict[str, list[int]] = {}
        for k, lang in enumerate(self.langs):
            shares, total = model["scripts"][lang], sum(model["scripts"][lang].values())
            for script, n in shares.items():
                if n >= SCRIPT_SHARE * total:
                    self.script_langs.setdefault(script, []).append(k)
        self.all = frozenset(range(len(self.langs)))
        self.scripts = BoundedCache(script_of, 100_000)
        self.pack = struct.Struct(f"<{len(self.langs) + 1}f").pack
        self.silent = bytes(4 * len(self.langs) + 4)
        self.words = BoundedCache(self._word, KEPT)

    def _word(self, word: str) -> bytes:
        """32-bit floats: the score in each language, 0 for the best one, and the number of letters."""
        letters = letters_of(word)
        if not letters:
            return self.silent
        fits = self.script_langs.get("latin" if letters.isascii() else self._script(letters), self.all)
        logs, unseen, marked = self.logs, self.unseen, f"^{letters}$"
        rows = [logs.get(marked[i : i + 3], unseen) for i in range(len(letters))]
        scores = [sum(x) for x in zip(*rows, strict=True)]
        best = max([scores[k] for k in fits])
        least = -WORD_MOST * max(1.0, len(letters) / WORD_LETTERS)  # a long run without white space says as much as several words
        return self.pack(*[max(least, x - best) if k in fits else least for k, x in enumerate(scores)], len(letters))

    def _script(self, letters: str) -> str:
        return Counter(map(self.scripts.__getitem__, letters)).most_common(1)[0][0]

    def matrix(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<f4").reshape(len(words), len(self.langs) + 1)

    def labels(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and the letters of each word."""
        found = self.matrix(words)
        return viterbi(found[:, :-1].astype(float)), found[:, -1]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = (text or "").split()
        if not words or not self.langs:
            return "und", 0.0
        labels, letters = self.labels(words)
        weight = np.bincount(labels, letters, len(self.langs))
        total = weight.sum()
        if not total:
            return "und", 0.0
        k = int(weight.argmax())
        return self.langs[k], float(weight[k] / total)

    def spans(self, text: str | None) -> list[dict]:
        words = (text or "").split()
        if not words or not self.langs:
            return []
        labels, letters = self.labels(words)
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(words)]
        return [{"first": a, "last": b - 1, "lang": self.langs[labels[a]] if letters[a:b].any() else "und"} for a, b in zip(cuts, cuts[1:], strict=False)]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row when each change of label costs ``switch``; of equals the first."""
    n, k = scores.shape
    one = int(scores.sum(0).argmax())
    if k == 1:
        return np.zeros(n, int)
    gain = np.concatenate(([0.0], np.cumsum((np.delete(scores, one, 1) - scores[:, one : one + 1]).max(1))))
    # Another label wins at most this on a stretch; one at either end costs a switch, one between costs two.
    if gain.max() <= switch and gain[-1] - gain.min() <= switch and (gain - np.minimum.accumulate(gain)).max() <= 2 * switch:
        return np.full(n, one)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        at = value.index(top)
        left = top - switch
        back.append([i if v >= left else at for i, v in enumerate(value)])
        value = [max(v, left) + x for v, x in zip(value, row, strict=True)]
    at = value.index(max(value))
    out = [at]
    for row in reversed(back):
        at = row[at]
        out.append(at)
    return np.array(out[::-1])


_scorers: dict[str, Scorer] = {}
BoundedCache.models.append(_scorers)


def _scorer(key: str, model: dict) -> Scorer:
    BoundedCache.working_on(__name__)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def predicted(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, lang_pred (``und`` for a null text or one without a letter), score (the share of letters in spans of
    that language) and spans (first and last word, lang; words are what white space separates).

    Rows that repeat, or have no id, each have their own row; of equally likely languages the first by name is taken; other
    columns are left out, so none can clash; an empty table gives an empty one. A model without languages gives ``und``.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(key, shared.value)
        texts = batch.column(1).to_pylist()
        found = [scorer.predict(t) for t in texts]
        return {"id": batch.column(0), "lang_pred": [x for x, _ in found], "score": [x for _, x in found], "spans": [scorer.spans(t) for t in texts]}

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, "id long, lang_pred string, score double, spans array<struct<first: int, last: int, lang: string>>").withColumnRenamed("id", id_col)


def labelled(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, lang_pred, score, as predicted() gives them for rows of any kind, without the spans."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(key, shared.value)
        found = [scorer.predict(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def kept(docs: DataFrame, model: dict, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language that ``least`` of its letters are in. Each row goes by
    its own text: rows that repeat, or have no id, are like others. A model without languages keeps all rows."""
    if not model["langs"]:
        return docs
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def keep(texts: list) -> list[bool]:
        scorer = _scorer(key, shared.value)
        return [lang != "und" and score >= least for lang, score in map(scorer.predict, texts)]

    return filtered_batches(docs, keep, "text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled() of all documents, by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return labelled(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
