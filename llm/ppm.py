"""Prediction by partial matching over bytes, trained on a corpus and applied to all of it.

The model is a trie of byte contexts up to ORDER bytes, kept as counts of (context, next byte). A byte
unseen in its context escapes to the next shorter one; escape estimation is method D (a symbol seen n times of N
has probability (2n - 1) / 2N, escape D / 2N with D different symbols), and symbols seen in the longer context are
excluded from the counts of the shorter ones. The order -1 shares what is left equally. Texts begin in a context of
0xFF bytes and end with that byte as a symbol (it occurs in no UTF-8 text), so probabilities of whole texts sum to one.

Neither the trie nor the word counts are ever in one place. A chunk of texts reduces to its distinct
grams (contexts with next byte) and distinct words, as arrays dealt into buckets: grams by the last two bytes of
their context, so that a bucket holds whole contexts of two and more bytes; words by hash. A bucket's task sums the
training counts of all chunks and answers every chunk with the log-probability of each of its grams, or with the counts of its words; the
chunk's task puts the answers together and sums them per text. What is shuffled grows with the corpus. The orders 0 and 1
(at most 65,536 counts) are the only thing that every task gets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents, shuffle_width, stage, table, texts_in_slices
from llm.hyperminhash import text_bytes, word_hashes

ORDER = 5
#: Text of one chunk, and of the slices in which its arrays are worked out.
CHUNK_BYTES = 16 << 20
SLICE_BYTES = 1 << 19
EDGE = 0xFF

U = np.uint64


def low_bytes(grams: np.ndarray, n: int) -> np.ndarray:
    return grams & U((1 << 8 * n) - 1)


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte of every symbol of all rows, symbols per row); the last byte is the symbol."""
    sizes = np.diff(offsets) + 1
    padded = np.full(len(data) + (order + 1) * len(sizes), EDGE, np.uint8)
    starts = np.arange(len(sizes)) * (order + 1) + offsets[:-1] + order
    inside = np.zeros(len(padded), bool)
    inside[np.repeat(starts, sizes - 1) + np.arange(len(data)) - np.repeat(offsets[:-1], sizes - 1)] = True
    padded[inside] = data
    inside[starts + sizes - 1] = True
    grams = padded.astype(U)
    for back in range(1, order + 1):
        grams[back:] |= padded[:-back].astype(U) << U(8 * back)
    return grams[inside], sizes


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found, n.astype(np.int64)


class Tally:
    """Distinct keys with training counts, merged whenever a few parts have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, train: np.ndarray, other: np.ndarray) -> None:
        keys, n = counted(train)
        rest = np.unique(other)
        self.parts += [(keys, n), (rest, np.zeros(len(rest), np.int64))]
        if len(self.parts) > 12:
            self.parts = [self.all()]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip(*self.parts)))


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of the wanted values in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Order:
    """Counts of one context length: sorted grams, and per context total, symbols and (against the shorter context) excluded counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, length: int, shorter: Order | None):
        self.grams, self.counts = summed(low_bytes(grams, length + 1), counts)
        contexts = self.grams >> U(8)
        first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, np.int64)
        self.contexts = contexts[first]
        self.total = np.add.reduceat(self.counts, first) if len(first) else self.counts
        self.symbols = np.diff(np.append(first, len(contexts)))
        if shorter is not None and len(first):
            at, _ = place(shorter.grams, low_bytes(self.grams, length))
            self.excluded = np.add.reduceat(shorter.counts[at], first)
        else:
            self.excluded = np.zeros(len(first), np.int64)


def orders_of(grams: np.ndarray, counts: np.ndarray, order: int, low: list[Order]) -> list[Order]:
    """All orders from full-length grams; ``low`` are the shortest ones, worked out elsewhere."""
    found = list(low)
    for length in range(len(low), order + 1):
        found.append(Order(grams, counts, length, found[-1] if found else None))
    return found


def log_probabilities(orders: list[Order], grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte in its context."""
    out = np.zeros(len(grams))
    live = np.ones(len(grams), bool)
    gone, gone_symbols = np.zeros(len(grams)), np.zeros(len(grams))
    for length in range(len(orders) - 1, -1, -1):
        level, own = orders[length], low_bytes(grams, length + 1)
        at, here = place(level.grams, own)
        count = np.where(here, level.counts[at] if len(level.counts) else 0, 0)
        at, seen = place(level.contexts, own >> U(8))
        pick = lambda values: np.where(seen, values[at], 0) if len(values) else np.zeros(len(own))
        total, symbols = pick(level.total) - gone, pick(level.symbols) - gone_symbols
        hit, escape = live & (count > 0), live & (count == 0) & (total > 0)
        out[hit] += np.log10((2 * count[hit] - 1) / (2 * total[hit]))
        out[escape] += np.log10(symbols[escape] / (2 * total[escape]))
        live &= count == 0
        gone, gone_symbols = pick(level.excluded), pick(level.symbols)
    if live.any():
        out[live] -= np.log10(256 - gone_symbols[live])
    return out


# ------------------------------------------------------------------ chunks

CHUNK = "chunk long, kind string, bucket int, size long, payload binary"
CHUNK_TYPES = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("bucket", pa.int32()), ("size", pa.int64()), ("payload", pa.binary())])


def squeezed(data: bytes | pa.Buffer) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: small numbers become runs of zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()


def from_planes(data: bytes, kind: type, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * size).reshape(8, size).T).view(kind).ravel()


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys by their differences, and a value each."""
    steps = np.diff(keys, prepend=U(0))
    body = planes(steps) + (planes(values) if values.dtype == np.int64 else values.tobytes())
    return squeezed(body)


def unpack(payload: bytes, size: int, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    body = pa.decompress(payload, 16 * size, "zstd", asbytes=True)
    rest = body[8 * size :]
    return np.cumsum(from_planes(body, U, size), dtype=U), from_planes(rest, kind, size) if kind is np.int64 else np.frombuffer(rest, kind)


def gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    context = (grams >> U(8)) & U(0xFFFF)
    return ((context * U(0x9E3779B97F4A7C15)) >> U(40)) % U(buckets)


def dealt(chunk: int, kind: str, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A chunk's keys and training counts, one row a bucket that has any; sorted within."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=bucket.dtype))
    for b in np.flatnonzero(np.diff(edges)):
        own = order[edges[b] : edges[b + 1]]
        yield chunk, kind, int(b), len(own), pack(keys[own], counts[own])


def chunks(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """Texts in chunks, with the distinct grams and words of each chunk and their training counts; ``train`` marks training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32

        def closed(number: int, parts: list[pa.RecordBatch]) -> Iterator[tuple]:
            chunk, grams, words, pairs = base + number, Tally(), Tally(), np.zeros(1 << 16, np.int64)
            for part in parts:
                data, offsets = text_bytes(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False)
                own, sizes = grams_of(data, offsets, order)
                by_symbol = np.repeat(train, sizes)
                grams.add(own[by_symbol], own[~by_symbol])
                pairs += np.bincount(low_bytes(own[by_symbol], 2).astype(np.int64), minlength=1 << 16)
                hashes, per_row = word_hashes(data, offsets)
                by_word = np.repeat(train, per_row)
                words.add(hashes[by_word], hashes[~by_word])
            keys, n = grams.all()
            yield from dealt(chunk, "gram", keys, n, gram_bucket(keys, buckets), buckets)
            keys, n = words.all()
            yield from dealt(chunk, "word", keys, n, (keys >> U(32)) % U(buckets), buckets)
            seen = np.flatnonzero(pairs)
            yield chunk, "pair", 0, len(seen), pack(seen.astype(U), pairs[seen])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as writer:
                for part in parts:
                    writer.write_batch(part)
            texts = sink.getvalue()
            yield chunk, "text", -1, texts.size, squeezed(texts)

        def out(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*closed(number, parts)), CHUNK_TYPES)], schema=CHUNK_TYPES)

        number, held, size = 0, [], 0
        for part in texts_in_slices(batches, SLICE_BYTES):
            held.append(part)
            size += part.nbytes
            if size >= CHUNK_BYTES:
                yield out(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield out(number, held)

    return rows.mapInArrow(run, CHUNK)


def low_orders(staged: DataFrame) -> list[Order]:
    """Orders 0 and 1 of the whole training corpus: at most 65,536 counts, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, payload in zip(batch.column("size").to_pylist(), batch.column("payload").to_pylist()):
                keys, n = unpack(payload, size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["pair", "n"])

    rows = staged.where("kind = 'pair'").select("size", "payload").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect()
    keys, n = np.array([r[0] for r in rows], U), np.array([r[1] for r in rows], np.int64)
    zero = Order(keys, n, 0, None)
    return [zero, Order(keys, n, 1, zero)]


ANSWER = "chunk long, kind string, bucket int, size long, payload binary, distinct_words long, train_words long"


def answers(staged: DataFrame, order: int, low: list[Order]) -> DataFrame:
    """Per chunk and bucket: its grams with their log-probabilities, or its words with their training counts."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["chunk", "kind", "bucket", "size", "payload"]).sort_by([("chunk", "ascending")]).to_pylist()
        kind = rows[0]["kind"]
        sent = [unpack(r["payload"], r["size"]) for r in rows]
        keys, n = summed(*(np.concatenate(x) for x in zip(*sent)))
        distinct = total = 0
        if kind == "gram":
            trained = n > 0
            told = log_probabilities(orders_of(keys[trained], n[trained], order, low), keys)
        else:
            told, distinct, total = n, int((n > 0).sum()), int(n.sum())
        out = [pack(own, told[np.searchsorted(keys, own)]) for own, _ in sent]
        again = [0] * (len(rows) - 1)
        return pa.table(
            [pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([kind] * len(rows)), pa.array([r["bucket"] for r in rows], pa.int32()), pa.array([r["size"] for r in rows], pa.int64()), pa.array(out, pa.binary()), pa.array([distinct, *again], pa.int64()), pa.array([total, *again], pa.int64())],
            names=[c.split()[0] for c in ANSWER.split(", ")],
        )

    return staged.where("kind IN ('gram', 'word')").groupBy("kind", "bucket").applyInArrow(run, ANSWER)


SCORED = "doc_id long, n_tokens long, n_known long, known_log double, score double, n_bytes long"


def scored(parts: DataFrame, order: int) -> DataFrame:
    """Per text: tokens, known tokens, sum of log10(count + 0.5) over its tokens, and the model's log10 probability."""

    def run(group: pa.Table) -> pa.Table:
        held: dict[str, list] = {"gram": [], "word": []}
        text = None
        for r in group.select(["kind", "size", "payload"]).to_pylist():
            if r["kind"] == "text":
                text = pa.decompress(r["payload"], r["size"], "zstd")
            else:
                held[r["kind"]].append(unpack(r["payload"], r["size"], np.float64 if r["kind"] == "gram" else np.int64))
        tables = {}
        for kind, found in held.items():
            keys, values = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, U), np.zeros(0))
            by = np.argsort(keys)
            tables[kind] = keys[by], values[by]
        held.clear()
        (grams, logs), (words, counts) = tables["gram"], tables["word"]
        out = []
        for batch in pa.ipc.open_stream(text):
            for part in texts_in_slices(iter([batch]), SLICE_BYTES):
                data, offsets = text_bytes(part.column("text"))
                own, sizes = grams_of(data, offsets, order)
                ends = np.cumsum(sizes)
                score = np.add.reduceat(logs[np.searchsorted(grams, own)], ends - sizes)
                hashes, per_row = word_hashes(data, offsets)
                row = np.repeat(np.arange(len(sizes)), per_row)
                n = counts[np.searchsorted(words, hashes)] if len(hashes) else np.zeros(0, np.int64)
                out.append(
                    pa.table(
                        [part.column("doc_id"), pa.array(per_row + 1), pa.array(np.bincount(row, n > 0, len(sizes)).astype(np.int64)), pa.array(np.bincount(row, np.log10(n + 0.5), len(sizes)).astype(float)), pa.array(score), pa.array(sizes - 1)],
                        names=[c.split()[0] for c in SCORED.split(", ")],
                    )
                )
        return pa.concat_tables(out)

    return parts.groupBy("chunk").applyInArrow(run, SCORED)


def ppm_scores(df: DataFrame, train: str, order: int = ORDER) -> DataFrame:
    """Per row of (doc_id, text): code length under the model and the unigram base, see ``op10``.

    ``train`` is a SQL condition on doc_id for the rows to learn from. A null or empty text is just its
    end; it still counts in training. Rows are scored on their own, repeated or without id; a null condition (as of a null id)
    learns. An untrained model (no row to learn from, or an empty table) spreads evenly over bytes. Extra columns are ignored.
    ``words`` are A-Z lower-cased runs without ASCII white space, compared by 64-bit hashes.
    """
    spark = df.sparkSession
    rows = documents(df).withColumn("train", F.coalesce(F.expr(train), F.lit(True)))
    staged = stage(chunks(rows, order, shuffle_width(spark)), "op10-chunks")
    told = stage(answers(staged, order, low_orders(staged)), "op10-answers")
    sums = told.agg(F.coalesce(F.sum("distinct_words"), F.lit(0)), F.coalesce(F.sum("train_words"), F.lit(0))).first()
    trained = rows.where("train").count()
    parts = staged.where("kind = 'text'").select("chunk", "kind", "size", "payload").union(told.select("chunk", "kind", "size", "payload"))
    # the end of a text is a token too: seen once in every training text
    tokens, kinds = sums[1] + trained, sums[0] + (trained > 0)
    out = scored(parts, order)
    base = F.col("known_log") + math.log10(trained + 0.5) - F.col("n_tokens") * math.log10(tokens + 0.5 * (kinds + 1))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.lit(int(trained > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        "n_bytes",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = "crc32(cast(cast(doc_id AS string) AS binary)) % 5"
    scores = ppm_scores(table(spark, sf_dir, "documents"), f"{fold} != 1")
    return scores.withColumn("held_out", F.expr(f"coalesce({fold} = 1, false)")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
