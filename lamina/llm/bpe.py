"""Byte-level BPE by a finite-state transducer.

The merges are compiled lazily. A state holds, for each place where a token may still be growing, the trie node reached
from there, the token before it and the tokens not yet emitted; the part that all of them share is emitted. Reading one
more byte follows every trie node at once (determinisation), and settles the token that ends here: the longest token
whose start has a compatible token before it. Two tokens are compatible when the merges leave their joined bytes as just
these two; a text's encoding is the only chain of tokens whose neighbours all are. No token is longer than the longest
of the vocabulary, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import BoundedCache, map_batches, table

#: States and pair checks kept at once; beyond them the tables start anew.
STATE_LIMIT, PAIR_LIMIT = 200_000, 200_000
#: Ids of so many different words are kept in each worker.
WORD_LIMIT = 600_000


class Transducer:
    """Encodes bytes of one pre-token by ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for b in token:
                child = self.children[node].get(b)
                if child is None:
                    child = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = child
            self.token_at[node] = i
        self.pairs = BoundedCache(self._stay_apart, PAIR_LIMIT)
        self.halves = BoundedCache(self._split, len(ranks))
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states, self.numbers = [start], {start: 0}
        self.steps: dict[int, tuple[int, tuple]] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that the merges never reach."""
        data = self.tokens[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
            if rank >= token:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _stay_apart(self, pair: tuple[int, int]) -> bool:
        """Whether the merges leave these two tokens as they are when one follows the other.

        Their merges are undone, the latest first, and what then stands on both sides of the border must not merge before
        the undone merge does. Of merges with equal rank the left one comes first.
        """
        left, right = pair
        bound = 1 << 40
        while True:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right])
            if rank is not None and rank < bound:
                return False
            a, b = self.halves[left], self.halves[right]
            if b is None or a is not None and left > right:
                if a is None:
                    return True
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def _step(self, number: int, byte: int) -> tuple[int, tuple]:
        """The next state and what is emitted on the way to it."""
        live, ended = [], None
        children, token_at = self.children, self.token_at
        for node, last, pending in self.states[number]:
            child = children[node].get(byte)
            if child is None:
                continue
            if ended is None:
                token = token_at[child]
                if token >= 0 and (last < 0 or self.pairs[last, token]):
                    ended = (0, token, (*pending, token))
            if children[child]:
                live.append((child, last, pending))
        if ended is None:
            raise ValueError("the vocabulary has no token for a byte")
        whole = ended[2]
        shared = len(whole)
        for _, _, pending in live:
            most, shared = min(shared, len(pending)), 0
            while shared < most and pending[shared] == whole[shared]:
                shared += 1
            if not shared:
                break
        live.append(ended)
        state = tuple((n, t, p[shared:]) for n, t, p in live) if shared else tuple(live)
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
        made = self.steps[number << 8 | byte] = (known, whole[:shared])
        return made

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > STATE_LIMIT:
            self._reset()
        out: list[int] = []
        number, steps = 0, self.steps
        for byte in data:
            number, emitted = steps.get(number << 8 | byte) or self._step(number, byte)
            if emitted:
                out += emitted
        return out + list(self.states[number][-1][2])


class Utf8:
    """An incremental UTF-8 state machine: its state is the bytes of a character that has begun; unfit bytes become U+FFFD."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _room(pending: bytes) -> tuple[int, int, int]:
        """How many bytes a character that began so has, and the range of its next byte."""
        first = pending[0]
        size = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        if len(pending) == 1:
            return size, {0xE0: 0xA0, 0xF0: 0x90}.get(first, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(first, 0xBF)
        return size, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        """The characters that data ends. Where none has begun, those that are whole are taken together: only the bytes of a last
        one that goes on, and data that no text has, go through the machine byte by byte."""
        out, pending = [], self.pending
        if not pending:
            try:
                return data.decode()
            except UnicodeDecodeError as e:
                if e.end == len(data):
                    out.append(data[: e.start].decode())
                    data = data[e.start :]
        for byte in data:
            if pending:
                size, low, high = self._room(pending)
                if low <= byte <= high:
                    pending += bytes((byte,))
                    if len(pending) == size:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("�")
                pending = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                pending = bytes((byte,))
            else:
                out.append("�")
        self.pending = pending
        return "".join(out)

    def end(self) -> str:
        left, self.pending = "�" * bool(self.pending), b""
        return left


def _characters() -> str:
    return "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))


def _class(found: list[str]) -> str:
    """Characters, ascending, as ranges of a character class."""
    out: list[list[int]] = []
    for c in map(ord, found):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def unlike_the_library() -> tuple[str, str]:
    """Character classes of the letters and of the numbers of ``regex`` that aren't such to tiktoken, whose Unicode tables are
    older: asked of the library itself, in one call for each, so that both agree whatever their versions are."""
    import tiktoken

    every, found = _characters(), []
    for kind in (r"\p{L}", r"\p{N}"):
        asked = tiktoken.Encoding("characters", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(asked.decode(asked.encode_ordinary(every)))
        ours = regex.findall(kind, every)
        if not theirs <= set(ours):
            raise ValueError("tiktoken's Unicode tables are newer than those of regex")
        found.append(_class([c for c in ours if c not in theirs]))
    return found[0], found[1]


class ByteBpe:
    """Encodes and decodes whole texts as the rank file says, each match of the pattern by itself.

    A text with a character that only ``regex`` takes for a letter or a number is split by a pattern without these, which is
    slower; other texts are split by the pattern as it is.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        letters, numbers = unlike_the_library()
        self.unlike = regex.compile(f"[{letters}{numbers}]") if letters or numbers else None
        same = pattern
        for kind, others in ((r"\p{L}", letters), (r"\p{N}", numbers)):
            if others:
                same = same.replace(kind, f"[{kind}--[{others}]]")
        self.same = regex.compile(same, regex.V1)
        self.fst = Transducer(ranks)
        self.spaced = BoundedCache(lambda word: self._word(" " + word), WORD_LIMIT)
        self.piece = BoundedCache(lambda piece: self.fst.encode(piece.encode()), WORD_LIMIT)
        size = max(ranks.values()) + 1
        self.tokens = [self.fst.tokens.get(i, b"") for i in range(size)]

    def _ids(self, text: str) -> bytes:
        pattern = self.same if self.unlike and not text.isascii() and self.unlike.search(text) else self.pattern
        found = pattern.findall(text)
        if len(found) == 1 and len(text) < 64:  # a word, whose ids are kept as such
            return np.array(self.fst.encode(found[0].encode()), "<u4").tobytes()
        ids = list(chain.from_iterable(self.piece[p] if len(p) < 64 else self.fst.encode(p.encode()) for p in found))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, spaced: str) -> bytes | None:
        """Ids of a space and a word after it; None where white space stands beside that space: then the whole text is split by the pattern."""
        if len(spaced) == 1 or spaced[1].isspace() or spaced[-1].isspace():
            return None
        return self._ids(spaced)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. A single space between two other characters always starts a match of the
        pattern, so a text falls apart there, and each word's ids are kept."""
        first, *words = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return b"".join((self._ids(first), *map(self.spaced.__getitem__, words)))
            except TypeError:  # a word that has None
                pass
        return self._ids(text)

    def decode(self, ids: bytes, chunk: int = 1 << 16) -> str:
        """The text of ids, decoded as a stream: chunks of ids go through the state machine one after another."""
        out, machine = [], Utf8()
        all_ids = np.frombuffer(ids, "<u4")
        for at in range(0, len(all_ids), chunk):
            out.append(machine.feed(b"".join(map(self.tokens.__getitem__, all_ids[at : at + chunk].tolist()))))
        out.append(machine.end())
        return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process; the tokenizer's file is on every machine."""
    coder = ByteBpe(read_ranks(path), pattern)
    # The vocabulary and the tables that grow with the words hold no garbage, and are large: they are searched for it less often.
    gc.freeze()
    gc.set_threshold(100_000)
    return coder


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, ids (binary, little-endian 32-bit), n_tokens, decoded text of the ids.

    A null text counts as empty: no ids. Rows with equal ids or texts each have their own row; other columns are left out,
    so none can clash. Texts are encoded whole, of any length.
    """

    def run(batch: pa.RecordBatch) -> dict:
        BoundedCache.working_on(__name__)
        coder = byte_bpe(path, pattern)
        ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [coder.decode(x) for x in ids]}

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), run, "id long, ids binary, n_tokens long, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. The digests are taken where the ids are made, so that
    ids and texts needn't leave the worker.

    A null text counts as empty: no ids, the digests of nothing. Rows that repeat, or have no doc_id, each have their own row;
    equal texts have equal digests. Other columns are left out, so none can clash; an empty table gives an empty one. Texts are
    encoded whole, of any length.
    """

    def run(batch: pa.RecordBatch) -> dict:
        BoundedCache.working_on(__name__)
        coder = byte_bpe(path, pattern)
        out: dict = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column(1).to_pylist():
            ids = coder.encode(text or "")
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
        return out

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digests() of all documents by the vocabulary of 50k byte-level tokens."""
    return digests(table(spark, sf_dir, "documents"), *vocabulary())
