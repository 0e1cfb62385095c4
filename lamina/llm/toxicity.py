"""Toxic passages as maximum-scoring segments.

A token's score is its log-odds between toxic and other texts, both counted with a Dirichlet prior, less a drift that makes the
expected score negative. A linear-time scan finds every maximal segment of a text. How good the best segment of a clean text of
n tokens is by chance follows an extreme-value law, P(best > s) = 1 - exp(-K n exp(-lambda s)), whose K and lambda are fitted to
clean texts that no score was learned from. A segment counts with the excess of lambda s over log(K n), and the sum over a
text's segments becomes a probability by a logistic fit.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, bounded_sample, filtered_batches, held_out, map_batches, saved, table

#: Labelled rows that scores and calibration are learned from at most.
SAMPLE = 30_000
#: The Dirichlet prior's count of a token as a share of the toxic texts, dealt to both kinds of text in proportion to all their
#: tokens: a token seen less often than that says little. Log-odds nearer to 0 than ODDS_LEAST count as 0, and aren't kept.
PRIOR, ODDS_LEAST, DRIFT = 0.1, 0.25, 1.0
#: Lengths of word beginnings that stand for words without log-odds themselves.
STEMS = (6, 5, 4)
THRESHOLD = 0.3
KEPT = 300_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def normal(word: str) -> str:
    return word.strip(_EDGES).lower()


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def token_odds(rows: DataFrame) -> dict[str, float]:
    """Log-odds of tokens and word beginnings between toxic and other texts, from rows (text, toxic). Each text counts a token once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({f for w in set((text or "").split()) if (x := normal(w)) for f in features_of(x)})
            if len(counts[0]) > 300_000:
                yield emitted(counts)
                counts = {0: Counter(), 1: Counter()}
        yield emitted(counts)

    def emitted(counts: dict[int, Counter]) -> pa.RecordBatch:
        keys = list(counts[0] | counts[1])
        return pa.RecordBatch.from_pydict({"token": pa.array(keys, pa.string()), "n0": pa.array([counts[0][k] for k in keys], pa.int64()), "n1": pa.array([counts[1][k] for k in keys], pa.int64())})

    made = rows.select("text", "toxic").mapInArrow(counted, "token string, n0 long, n1 long")
    summed = saved(made.groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "tokens")
    t0, t1 = summed.agg(F.sum("n0"), F.sum("n1")).first()
    if not t0 or not t1:
        return {}
    prior = PRIOR * rows.where("toxic = 1").count()
    p0, p1 = prior * t0 / (t0 + t1), prior * t1 / (t0 + t1)
    a, b = F.col("n1") + p1, F.col("n0") + p0
    odds = F.log(a / (t1 + prior - a)) - F.log(b / (t0 + prior - b))
    return {r.token: r.odds for r in summed.select("token", odds.alias("odds")).where(F.abs("odds") >= ODDS_LEAST).collect()}  # bounded by the sample


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last position, score) of a sequence of scores.

    Linear: each segment keeps the place of the nearest one before it that begins at a lower sum, so a search backwards skips
    what lies between, and a segment that is joined to a later one is met no more.
    """
    sums = np.cumsum(scores, dtype=float)
    at = np.flatnonzero(scores > 0)
    segments: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the one before with a lower sum
    for i, after, score in zip(at.tolist(), sums[at].tolist(), scores[at].tolist(), strict=True):
        first, before = i, after - score
        j = len(segments) - 1
        while True:
            while j >= 0 and segments[j][2] >= before:
                j = segments[j][4]
            if j < 0 or segments[j][3] >= after:
                break
            first, before = segments[j][0], segments[j][2]
            up = segments[j][4]
            del segments[j:]
            j = up
        segments.append((first, i, before, after, j))
    return [(a, b, y - x) for a, b, x, y, _ in segments]


def extreme_value_fit(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lambda and K of the largest likelihood for best scores of clean texts with n tokens each: for each lambda the best K is
    known, and the likelihood left, which is concave in lambda, is searched by thirds."""
    spread = float(best.std())
    if len(n) < 2 or not spread:
        return 1.0, 1.0 / max(1.0, float(n.mean()) if len(n) else 1.0)
    low = float(best.min())

    def fitted(rate: float) -> tuple[float, float]:
        each = n * np.exp(-rate * (best - low))
        k = len(n) / each.sum()  # of scores less low
        return float(np.log(k * n * rate).sum() - rate * (best - low).sum() - k * each.sum()), math.log(k) + rate * low

    a, b = 1e-3 / spread, 1e2 / spread
    for _ in range(100):
        x, y = a + (b - a) / 3, b - (b - a) / 3
        a, b = (x, b) if fitted(x)[0] < fitted(y)[0] else (a, y)
    return (a + b) / 2, math.exp(max(-700.0, min(700.0, fitted((a + b) / 2)[1])))


class Scorer:
    """Segments and scores of texts by a model from learn()."""

    def __init__(self, model: dict):
        self.odds, self.model = model["odds"], model
        self.words = BoundedCache(self._word, KEPT)

    def _word(self, word: str) -> bytes:
        known = next((self.odds[f] for f in features_of(normal(word)) if f in self.odds), 0.0)
        return np.float32(known - DRIFT).tobytes()

    def segments(self, text: str | None) -> tuple[int, float, list[tuple[int, int, float]]]:
        """The number of words, the best score of any stretch of them, and the maximal segments over word numbers."""
        words = (text or "").split()
        if not words:
            return 0, 0.0, []
        scores = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<f4")
        found = maximal_segments(scores)
        return len(words), max((s for *_, s in found), default=float(scores.max())), found

    def chance(self, n: int) -> float:
        """log(K n): what lambda times the best score of a clean text of n words exceeds in about two of three."""
        return math.log(self.model["k"]) + math.log(max(1, n))

    def significant(self, text: str | None) -> list[tuple[int, int, float]]:
        """Segments (first, last word, excess over what chance gives a text of this length)."""
        n, _, found = self.segments(text)
        chance = self.chance(n)
        return [(a, b, x) for a, b, s in found if (x := self.model["lambda"] * s - chance) > 0]

    def evidence(self, text: str | None) -> float:
        return sum(x for _, _, x in self.significant(text))

    def probability(self, evidence: float) -> float:
        a, b = self.model["logistic"]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(evidence)))))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the log-odds a + b x, by Newton steps with a weak prior that keeps separable data finite."""
    design = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), design.T @ (y - p) - 0.1 * w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def learn(rows: DataFrame) -> dict:
    """The model from rows (doc_id, text, toxic): odds from three quarters of them, calibration from the rest.

    Rows whose toxic is neither 0 nor 1 are left out; a null text has no token; rows that repeat count as often; other columns
    aren't read. Without rows of either kind every text gets the score of no evidence.
    """
    taken = rows.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0
    model: dict = {"odds": token_odds(taken.where(~apart)), "lambda": 1.0, "k": 1.0, "logistic": (-3.0, 0.0)}
    if not model["odds"]:
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measured(batch: pa.RecordBatch) -> dict:
        scorer = Scorer(shared.value)
        found = [scorer.segments(t) for t in batch.column(0).to_pylist()]
        return {"n": [n for n, *_ in found], "best": [x for _, x, _ in found], "scores": [[s for *_, s in segs] for *_, segs in found], "toxic": batch.column(1)}

    found = saved(map_batches(taken.where(apart).select("text", "toxic"), measured, "n int, best double, scores array<double>, toxic int"), "calibration")
    clean = np.array([(r.n, r.best) for r in found.where("toxic = 0 and n > 0").select("n", "best").collect()], float).reshape(-1, 2)  # a quarter of the sample
    model["lambda"], model["k"] = extreme_value_fit(clean[:, 0], clean[:, 1])
    chance = F.lit(math.log(model["k"])) + F.log(F.greatest(F.lit(1), "n"))
    evidence = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), s * F.lit(model["lambda"]) - chance))
    x, y = np.array([(r.x, r.toxic) for r in found.select(F.log1p(evidence).alias("x"), "toxic").collect()], float).reshape(-1, 2).T
    model["logistic"] = logistic_fit(x, y)
    return model


_scorers: dict[str, Scorer] = {}
BoundedCache.models.append(_scorers)


def _scorer(key: str, model: dict) -> Scorer:
    BoundedCache.working_on(__name__)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, score (0 to 1), predicted (1 from THRESHOLD on) and passages (first and last word, excess).

    A null or empty text has no passage and the score of no evidence. Rows that repeat, or have no id, each have their own
    row; equal texts have equal scores. Other columns are left out, so none can clash; an empty table gives an empty one.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(key, shared.value)
        found = [scorer.significant(t) for t in batch.column(1).to_pylist()]
        scores = [scorer.probability(sum(x for _, _, x in segs)) for segs in found]
        return {"id": batch.column(0), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores], "passages": [[{"first": a, "last": b, "excess": x} for a, b, x in segs] for segs in found]}

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, "id long, score double, predicted int, passages array<struct<first: int, last: int, excess: double>>").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted to be toxic. Each row goes by its own text: rows that
    repeat, or have no id, are like others."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def keep(texts: list) -> list[bool]:
        scorer = _scorer(key, shared.value)
        return [scorer.probability(scorer.evidence(t)) < THRESHOLD for t in texts]

    return filtered_batches(docs, keep, "text")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts with labels that may be learned from: about ``sample`` labels, chosen by a hash of the id and at most twice as
    many, which are therefore broadcast; the texts aren't shuffled."""
    free = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    taken = bounded_sample(free, sample).limit(2 * sample)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(taken), "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() of all documents, by a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(training_rows(docs, table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "passages")
