"""Token counts by a two-tier lookup on the map side.

A word with the space before it is a pre-token: no piece of the model has a space after another character. The lengths of
frequent pre-tokens, those that the model's own vocabulary ranks as pieces, are broadcast as a compact table of bounded size;
every other one is encoded where it occurs, through a cache of bounded size in each worker, which soon holds what is frequent in
the texts at hand. Texts are read once and nothing is shuffled. The table and the caches only save work; a count never depends
on them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BoundedCache, map_batches, table

#: Entries of the broadcast table at most: under 2 MB for any vocabulary.
FREQUENT = 65_536
#: Lengths kept in a worker.
KEPT = 400_000

_UNIT = regex.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lengths:
    """Counts tokens of texts with the model at path."""

    def __init__(self, path: str, frequent: tuple[str, bytes] = ("", b"")):
        self.encode = _processor(path).encode
        words = frequent[0].split(" ") if frequent[1] else []
        self.known = dict(zip(words, np.frombuffer(frequent[1], "<u4").tolist(), strict=True))
        # nothing after a space: a single space at the end of a text
        self.misses = BoundedCache(lambda unit: len(self.encode(unit, num_threads=1)) if unit else 1, KEPT)

    def of(self, text: str) -> int:
        if not text:
            return 0
        if "▁" in text:  # the model's own sign for a space
            text = text.replace("▁", " ")
        units = text.split(" ")
        if "" in units:  # the model puts one space before a text; runs of spaces stay with what follows
            units = [u[1:] for u in _UNIT.findall(" " + text)]
        total, misses, known = 0, self.misses, self.known.get
        for unit in units:
            n = known(unit)
            total += misses[unit] if n is None else n
        return total


def frequent_lengths(path: str, entries: int = FREQUENT) -> tuple[str, bytes]:
    """Pre-tokens that the model's vocabulary has as pieces, joined by spaces, and their lengths: the first ``entries`` by rank.

    A vocabulary ranks pieces by how frequent they are, so no text is read for it, and no pre-token of any is counted.
    """
    model = _processor(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    words = [p[1:] for p in pieces if p[:1] == "▁" and len(p) > 1 and "▁" not in p[1:] and " " not in p][:entries]
    return " ".join(words), np.array([len(ids) for ids in model.encode(words, num_threads=1)], "<u4").tobytes()


@lru_cache(maxsize=1)
def _lengths(path: str, key: tuple[str, bytes]) -> Lengths:
    return Lengths(path, key)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has none of either. Repeated rows each have a row, and so do rows with a null id; other columns are
    left out, so none can clash. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def run(batch: pa.RecordBatch) -> dict:
        BoundedCache.working_on(__name__)
        lengths, texts = _lengths(path, shared.value), batch.column(1).to_pylist()
        n = [lengths.of(t) if t else 0 for t in texts]
        return {"id": batch.column(0), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents by the model of 32k pieces."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
