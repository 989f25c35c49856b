"""Vector bin packing of tokenised examples into training sequences.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. The
dot-product heuristic fills one open sequence at a time: of all waiting examples that fit whole it
takes the one whose demand vector has the largest weighted dot product with what is left of the
sequence; if none fits whole, the best one is cut and its front part closes the sequence. The
loss-bearing tokens of an example are those after its prompt.

Every task packs its own rows, with a bounded pool of waiting examples; at its end the last sequence
is cut into pieces of a power of two, which need no padding. Sequence ids carry the task's number.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from llm.common import documents, strings, table

#: Entries of a worker's word cache; it is emptied when full.
CACHE = 400_000

_LETTERS = "a-zß-öø-ÿ"
#: Texts of these characters only (each its own normal form) are split here; others go through the library's own splitting.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The splitting rule of the tokenizer file, for plain lower-case text.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
_BLANKS = re.compile("[ \t\n\r]+")


class Words(dict):
    """Word → its ids as little-endian 32-bit bytes, filled on demand.

    White space never reaches a merge, so a text's ids are those of its words one after the other,
    and a word's are those of its pieces.
    """

    def __init__(self, file: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = [chr(i) for i in range(0x21, 0x7F)] + [chr(i) for i in range(0xDF, 0x100)]
        self.shown = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in shown}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if _PLAIN.fullmatch(word):
            ids = [token.id for piece in _PIECE.findall(word.lower()) for token in self.model.tokenize(piece.translate(self.shown))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        words = text.lower().split() if _PLAIN.fullmatch(text) else [w for w in _BLANKS.split(text) if w]
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def words_of(file: str) -> Words:
    return Words(file)


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``tokens`` is a power of two or any other padded length."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class Pool:
    """Waiting examples as parallel arrays; ``take`` removes by moving the last one into the gap."""

    def __init__(self, size: int):
        self.keys, self.ids = [None] * size, [b""] * size
        self.start, self.left, self.prompt = (np.zeros(size, np.int64) for _ in range(3))
        self.size = 0

    def add(self, key, ids: bytes, prompt: int) -> None:
        i = self.size
        self.keys[i], self.ids[i], self.start[i], self.left[i], self.prompt[i] = key, ids, 0, len(ids) // 4, prompt
        self.size += 1

    def loss(self) -> np.ndarray:
        return np.minimum(self.left[: self.size], self.start[: self.size] + self.left[: self.size] - self.prompt[: self.size]).clip(0)

    def cut(self, i: int, tokens: int):
        """The next ``tokens`` ids of example i; what is left of it stays."""
        start, key, ids = int(self.start[i]), self.keys[i], self.ids[i]
        piece = (key, start, tokens, len(ids) // 4, ids[4 * start : 4 * (start + tokens)], max(0, start + tokens - max(start, int(self.prompt[i]))))
        self.start[i] += tokens
        self.left[i] -= tokens
        if not self.left[i]:
            j = self.size = self.size - 1
            self.keys[i], self.ids[i] = self.keys[j], self.ids[j]
            for a in (self.start, self.left, self.prompt):
                a[i] = a[j]
            self.keys[j], self.ids[j] = None, b""
        return piece


def fill(pool: Pool, limits: Limits) -> list[tuple]:
    """One sequence from the pool: whole examples by largest dot product, then a cut one."""
    room, loss_room, pieces = limits.tokens, limits.loss, []
    weights = 1 / limits.tokens**2, 1 / limits.segments**2, 1 / max(1, limits.loss) ** 2
    while pool.size and room and len(pieces) < limits.segments:
        left, loss = pool.left[: pool.size], pool.loss()
        score = left * (room * weights[0]) + (limits.segments - len(pieces)) * weights[1] + loss * (loss_room * weights[2])
        fits = (left <= room) & (loss <= loss_room)
        if fits.any():
            i = int(np.argmax(np.where(fits, score, -1)))
            tokens = int(left[i])
        else:
            i = int(np.argmax(score))
            free = max(0, int(pool.prompt[i] - pool.start[i]))  # prompt tokens still to come bear no loss
            tokens = min(room, int(left[i]), free + loss_room)
            if not tokens:
                break
        pieces.append(pool.cut(i, tokens))
        room -= tokens
        loss_room -= pieces[-1][5]
    return pieces


def halves(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """A short sequence as sequences of a power of two, which need no padding."""
    total, queue = sum(p[2] for p in pieces), list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, part = total & (1 << bit), []
        while room:
            key, start, n, whole, ids, loss = queue.pop(0)
            k = min(room, n)
            front = min(loss, max(0, k - (n - loss)))  # the prompt lies in front
            part.append((key, start, k, whole, ids[: 4 * k], front))
            if k < n:
                queue.insert(0, (key, start + k, n - k, whole, ids[4 * k :], loss - front))
            room -= k
        if part:
            yield part


def pack(examples: Iterator[tuple], limits: Limits, waiting: int) -> Iterator[list[tuple]]:
    """Sequences of pieces (key, start, length, example's length, ids, loss tokens) from (key, ids, prompt length)."""
    pool, more = Pool(waiting), True
    while True:
        while more and pool.size < waiting:
            item = next(examples, None)
            more = item is not None
            if more and item[1]:
                pool.add(*item)
        if not pool.size:
            return
        pieces = fill(pool, limits)
        if sum(p[2] for p in pieces) == limits.tokens:
            yield pieces
        else:
            yield from halves(pieces)


SCHEMA = "doc_id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"


def vector_pack(df: DataFrame, tokenizer_file: str, end_id: int = 1, limits: Limits = Limits(), prompt: str | None = None, waiting: int = 2048) -> DataFrame:
    """Pieces of (doc_id, text) rows packed into sequences; ``ids`` are little-endian 32-bit.

    Each text's ids end with ``end_id``; a null or empty text is that id alone. ``prompt`` names a
    column with the number of leading ids that bear no loss (null or negative: none). Every id lies in one
    piece and every sequence keeps the three limits. Repeated rows and null ids are packed as rows of
    their own; an empty table gives no pieces; other columns are ignored.
    """
    if limits.loss < 1 or limits.segments < 1 or limits.tokens < 1:
        raise ValueError("each limit must leave room for a token")
    lead = F.greatest(F.coalesce(F.col(prompt).cast("long"), F.lit(0)), F.lit(0)) if prompt else F.lit(0).cast("long")
    rows = documents(df) if not prompt else df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lead.alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = words_of(tokenizer_file), np.array([end_id], "<u4").tobytes()

        def examples():
            for batch in batches:
                leads = batch.column("prompt").to_pylist() if prompt else [0] * batch.num_rows
                for key, text, n in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), leads):
                    yield key, words.encode(text) + end, n

        def out():
            columns = list(zip(*rows_out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.binary()])], NAMES)

        number, rows_out, held = TaskContext.get().partitionId() << 36, [], 0
        for pieces in pack(examples(), limits, waiting):
            offset = 0
            for key, start, n, whole, ids, loss in pieces:
                rows_out.append((key, start, n, whole, loss, number, offset, ids))
                offset += n
            number += 1
            held += offset
            if held > 1 << 20:
                yield out()
                rows_out, held = [], 0
        if rows_out:
            yield out()

    return rows.mapInArrow(run, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def packed_documents(df: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = vector_pack(df, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
