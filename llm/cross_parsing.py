"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its labelled texts. A text is parsed against it
from left to right into longest phrases: each is the longest piece from there on that occurs in the sample, or one
unknown byte. Phrases times the binary logarithm of the sample's size, by the bytes of the text, is an estimate of its cross entropy;
the language that needs least wins.

Texts are lower-cased, what is neither letter nor beyond ASCII becomes one blank, and UTF-8 bytes are the symbols. Phrases end at
every PIECE bytes, alike for all languages: pieces of all texts of a batch then go through the automata in step, one
table look-up a byte and language. Every byte of every text is parsed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, fold, strings, table, texts_in_slices

#: Bounds of the sample: documents of a language (about; 16 with very many languages), characters from each, bytes of all languages and of one.
DOCUMENTS, WINDOW, SAMPLE_BYTES, LANGUAGE_BYTES = 256, 256, 1 << 20, 1 << 15
PIECE = 512
SLICE_BYTES = 1 << 21
UNKNOWN = "und"

_BLANKS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
#: No byte of UTF-8; fills the last piece of a text.
_END = 0xFF


def plain(text: str) -> bytes:
    """Lower-case words, one blank between two."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())


class SuffixAutomaton:
    """The smallest automaton that reads just the substrings of the texts; no substring goes over a text's border."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, text: bytes) -> None:
        last = 0
        for c in text:
            last = self.extend(last, c)

    def state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def extend(self, last: int, c: int) -> int:
        """The state of the longest text so far, one symbol on."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self.split(last, c, known)
        new, p = self.state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, c, q)
        return new

    def split(self, p: int, c: int, q: int) -> int:
        """A state for those texts of ``q`` that end a step after ``p``."""
        copy = self.state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy


def parser(texts: list[bytes], symbols: np.ndarray) -> np.ndarray:
    """[state * width + symbol]: twice the row that follows, plus one where a phrase starts.

    Row 0 is the place between phrases. A symbol that does not go on with the phrase starts the next one;
    one that the language lacks is a phrase of its own. The last symbol ends a piece.
    """
    automaton = SuffixAutomaton()
    for text in texts:
        automaton.add(text)
    width = int(symbols.max()) + 1
    # row 0: between phrases; row 1 + s: state s
    starts = np.ones(width, np.int64)
    for c, t in automaton.next[0].items():
        starts[symbols[c]] = 2 * (1 + t) * width + 1
    rows = np.tile(starts, (1 + len(automaton.next), 1))
    for s, edges in enumerate(automaton.next):
        if s:
            for c, t in edges.items():
                rows[1 + s, symbols[c]] = 2 * (1 + t) * width
    rows[:, symbols[_END]] = 0
    return rows.reshape(-1).astype(np.int32)


class Model:
    """Languages, their parsers one after another, where each starts, and bits a phrase."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        seen = sorted({c for texts in samples.values() for t in texts for c in t})
        # symbol 0 stands for all bytes that no sample has
        self.symbols = np.zeros(256, np.int32)
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.symbols[_END] = len(seen) + 1
        tables = [parser(samples[name], self.symbols) for name in self.languages]
        self.starts = np.cumsum([0, *[len(t) for t in tables]])[:-1].astype(np.int32)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bits = np.array([math.log2(1 + sum(map(len, samples[name]))) for name in self.languages])

    def entropies(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: bits a byte of plain texts that are not empty."""
        found, held, owners, size = np.zeros((len(texts), len(self.languages))), [], [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), SLICE_BYTES):
                held.append(text[at : at + SLICE_BYTES])
                owners.append(i)
                size += len(held[-1])
                if size >= SLICE_BYTES:
                    np.add.at(found, owners, self.phrases(held))
                    held, owners, size = [], [], 0
        if held:
            np.add.at(found, owners, self.phrases(held))
        return found * self.bits / np.array([[len(t)] for t in texts])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]: phrases of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        filled = np.frombuffer(b"".join(t.ljust(n * PIECE, bytes([_END])) for t, n in zip(texts, pieces.tolist())), np.uint8)
        grid = np.ascontiguousarray(self.symbols[filled.reshape(-1, PIECE)].T)
        # long pieces first, so that short ones drop out together
        lengths = np.minimum(PIECE, sizes[owner] - PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)))
        order = np.argsort(-lengths, kind="stable")
        grid, alive = grid[:, order], np.searchsorted(-lengths[order], -np.arange(PIECE), side="left")
        counts = np.zeros((len(self.languages), len(owner)), np.int32)
        for i, start in enumerate(self.starts.tolist()):
            table, state, count = self.table[start:], np.zeros(len(owner), np.int32), counts[i]
            for k in range(PIECE):
                n = alive[k]
                if not n:
                    break
                step = table[state[:n] + grid[k, :n]]
                count[:n] += step & 1
                state[:n] = step >> 1
        found = np.zeros((len(self.languages), len(texts)))
        for row, count in zip(found, counts):
            row += np.bincount(owner[order], weights=count, minlength=len(texts))
        return found.T


def sample(df: DataFrame, learn: str) -> dict[str, list[bytes]]:
    """Plain windows of about DOCUMENTS documents of each language, those with the smallest hash of the id."""
    known = df.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(learn).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    known = known.where(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    each = max(16, min(DOCUMENTS, SAMPLE_BYTES // (WINDOW * len(counts))))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])[F.col("lang")]
    drawn = F.xxhash64("doc_id").cast("double") < F.lit(-(2.0**63)) + F.lit(2.0**64) * share
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.char_length("text") - (WINDOW - 1))) + 1
    rows = known.where(drawn | (share >= 1.0)).select("lang", "doc_id", F.substr("text", start.cast("int"), F.lit(WINDOW)).alias("text"))
    most = max(1, min(LANGUAGE_BYTES, SAMPLE_BYTES // len(counts)))
    samples: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in sorted(rows.limit(4 * each * len(counts)).collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        left = most - sum(map(len, samples[r["lang"]]))
        samples[r["lang"]].append(plain(r["text"])[: max(0, left)])
    return {lang: texts for lang, texts in samples.items() if any(texts)}


def languages(df: DataFrame, learn: str = "true") -> DataFrame:
    """Per row of (doc_id, text, lang): doc_id, lang_pred and score (0 to 1).

    Languages and their samples come from rows with an id, a lang and a letter in their text for which the SQL condition ``learn`` on doc_id
    holds. Predictions use the text alone: the language of least cross entropy, ties to the first name. Score: by how much of the
    next language's entropy the best one lies below it (a lone language is held against 8 bits a byte). A null text, one
    without any letter, or any text if there is nothing to learn from is ``und`` with score 0. Repeated rows and null ids are predicted like
    others; an empty table gives no rows; extra columns are ignored.
    """
    samples = sample(df, learn)
    model = df.sparkSession.sparkContext.broadcast(Model(samples)) if samples else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts_in_slices(batches, SLICE_BYTES):
            texts = strings(part.column("text"))
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            read = [i for i, t in enumerate(texts) if _LETTER.search(t)] if model is not None else []
            if read:
                bits = model.value.entropies([plain(texts[i]) for i in read])
                best, low = bits.argmin(axis=1), np.sort(bits, axis=1)
                scores[read] = 1 - low[:, 0] / (low[:, 1] if bits.shape[1] > 1 else np.maximum(8.0, low[:, 0]))
                for i, b in zip(read, best.tolist()):
                    names[i] = model.value.languages[b]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return documents(df).mapInArrow(run, "doc_id long, lang_pred string, score double")


HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(table(spark, sf_dir, "documents"), f"NOT ({HELD_OUT})")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
