"""Target-distribution importance resampling with a distributed LSD radix sort.

Every text's features are the runs of 1 to RUN words, each counted in one of ``buckets`` hashed buckets. The corpus and
the target are reduced to one array of counts each, and these to an array of gains; a document's weight is the sum of
its features' gains, read from that array. A Gumbel draw that follows from seed and id is added, so that the highest
scores are a sample without replacement whose odds follow the weights.

The order comes from a radix sort, least significant digit first, over the composite key (score downwards,
doc_id upwards). A pass counts the digits of each block of BLOCK places, turns the counts into global
offsets by a prefix sum over (digit, block) and moves every row to its destination; rows of one digit keep their order. Blocks
and the runs of the prefix sum are bounded, so no task holds more than a block whatever the keys are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import documents, stage, table, texts_in_slices
from llm.hyperminhash import text_bytes

RUN = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bits of a digit, of the place in a block, and of the place in a run of blocks.
DIGIT, BLOCK, STRIDE = 11, 16, 12
SLICE_BYTES = 4 << 20
#: Lengths in bytes for which the shift of a checksum is tabulated; longer ones are made up of these.
_SHIFTS = 48

U = np.uint32


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=U)
    for _ in range(8):
        values = np.where(values & U(1), (values >> U(1)) ^ U(0xEDB88320), values >> U(1))
    return values


_CRC = _crc_table()
#: What a word byte becomes (A-Z lower-cased); zero for bytes between words.
_WORD = np.zeros(256, np.uint8)
for _byte in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD[_byte] = _byte
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _shift_table() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, of value b, turns into when n bytes follow."""
    tables = np.zeros((_SHIFTS + 1, 4, 256), U)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=U) << U(8 * k)
    for n in range(1, _SHIFTS + 1):
        before = tables[n - 1]
        tables[n] = _CRC[before & U(0xFF)] ^ (before >> U(8))
    return tables


_SHIFT = _shift_table().reshape(-1)


def shifted(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The part of the checksum of a text in its continuation by ``sizes`` bytes."""
    far = np.flatnonzero(sizes > _SHIFTS)
    if len(far):
        crc, sizes = crc.copy(), sizes.copy()
        while len(far):
            crc[far] = shifted(crc[far], np.full(len(far), _SHIFTS))
            sizes[far] -= _SHIFTS
            far = far[sizes[far] > _SHIFTS]
    base = sizes.astype(np.int32) << 10
    out = _SHIFT[base + (crc & U(0xFF)).astype(np.int32)]
    for k in (1, 2, 3):
        out ^= _SHIFT[base + (256 * k) + ((crc >> U(8 * k)) & U(0xFF)).astype(np.int32)]
    return out


def word_checksums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32, bytes, row) of every word."""
    plain = _WORD[data]
    inside = plain != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = inside[starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[starts[starts > 0] - 1] = inside[starts[starts > 0] - 1]
    begins, sizes = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = sizes - begins
    rows = np.searchsorted(offsets[1:], begins, side="right")
    crc = np.full(len(begins), 0xFFFFFFFF, U)
    order = np.argsort(-np.minimum(sizes, 255).astype(np.int16), kind="stable")
    at, left, state = begins[order], sizes[order], crc[order]
    for k in range(int(min(left.max(initial=0), _SHIFTS))):
        n = np.searchsorted(-left, -k, side="left")  # words longer than k, at the front
        state[:n] = _CRC[(state[:n] ^ plain[at[:n] + k]) & U(0xFF)] ^ (state[:n] >> U(8))
    crc[order] = ~state
    for i in np.flatnonzero(sizes > _SHIFTS).tolist():
        crc[i] = zlib.crc32(plain[begins[i] : begins[i] + sizes[i]])
    return crc, sizes, rows


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per row, and (bucket, row) of all features by length of the run."""
    crc, sizes, rows = word_checksums(data, offsets)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    found = [((crc % U(buckets)).astype(np.int64), rows)]
    # a word after a blank, as it continues a run
    tail = shifted(np.full(len(crc), zlib.crc32(b" "), U), sizes) ^ crc
    run = crc
    for n in range(1, RUN):
        run = shifted(run[:-1], sizes[n:] + 1) ^ tail[n:]
        whole = rows[n:] == rows[:-n]
        found.append(((run[whole] % U(buckets)).astype(np.int64), rows[n:][whole]))
    return words, found


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; a task hands on at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in texts_in_slices(batches, SLICE_BYTES):
            for bucket, _ in feature_buckets(*text_bytes(part.column("text")), buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    size, all_, aim = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_ + size)) / ((s + 1) * (aim + size)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts_in_slices(batches, SLICE_BYTES):
            words, found = feature_buckets(*text_bytes(part.column("text")), buckets)
            n, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for bucket, row in found:
                n += np.bincount(row, minlength=len(words))
                ends = np.searchsorted(row, np.arange(len(words) + 1))
                weight += np.diff(np.concatenate([[0], np.cumsum(gains[bucket])])[ends])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A document's draw in thousandths; a null id draws like an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def before(cells: DataFrame, bits: int) -> DataFrame:
    """(digit, block, n, start): rows of the same digit in earlier blocks, summed in runs of 2^STRIDE blocks."""
    if bits <= 0:
        return cells.withColumn("start", F.lit(0).cast("long"))
    run = F.shiftright("block", STRIDE)
    runs = before(cells.groupBy("digit", run.alias("block")).agg(F.sum("n").alias("n")), bits - STRIDE)
    own = Window.partitionBy("digit", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = cells.withColumn("run", run).withColumn("within", F.coalesce(F.sum("n").over(own), F.lit(0)))
    outer = runs.select("digit", F.col("block").alias("run"), F.col("start").alias("base"))
    return inside.join(outer, ["digit", "run"]).select("digit", "block", "n", (F.col("base") + F.col("within")).alias("start"))


def radix_pass(rows: DataFrame, key: str, shift: int, bits: int) -> DataFrame:
    """The rows with their new place: stable by the digit of ``key`` at ``shift``."""
    rows = rows.withColumn("digit", F.shiftright(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))).withColumn("block", F.shiftright("place", BLOCK))
    cells = stage(rows.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n")), "op12-cells")
    # one row a digit at most
    digits = cells.groupBy("digit").agg(F.sum("n").alias("total"))
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = digits.select("digit", F.coalesce(F.sum("total").over(smaller), F.lit(0)).alias("offset"))
    offsets = before(cells, bits).join(digits, "digit").select("digit", "block", (F.col("start") + F.col("offset")).alias("first"))
    within = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    moved = rows.withColumn("within", within).join(offsets, ["digit", "block"])
    return moved.withColumn("place", F.col("first") + F.col("within")).drop("digit", "block", "first", "within")


def radix_ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with their rank (from 1) by the long columns ``keys``, ascending, most significant first.

    Rows that agree in all keys keep the order in which the table is staged. Digits in which all rows agree are
    left out, so the number of passes follows from the range of the keys.
    """
    spans = rows.agg(F.count(F.lit(1)), *[f(k) for k in keys for f in (F.min, F.max)]).first()
    if not spans[0]:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    lows = {k: spans[1 + 2 * i] for i, k in enumerate(keys)}
    widths = {k: spans[2 + 2 * i] - lows[k] for i, k in enumerate(keys)}
    shifted_keys = [(F.col(k) - F.lit(lows[k])).alias(k) if widths[k] < 1 << 63 else F.col(k) for k in keys]
    rest = [c for c in rows.columns if c not in keys]
    # a task's rows are numbered from its own multiple of 2^33
    placed = stage(rows.select(*rest, *keys, *[c.alias(f"_key_{k}") for c, k in zip(shifted_keys, keys)], F.monotonically_increasing_id().alias("place")), "op12-places")
    bits = placed.agg(F.max("place")).first()[0].bit_length() - BLOCK
    for k in reversed(keys):
        if widths[k] >= 1 << 63:  # the range of the key is wider than a long: its sign is the highest digit, flipped
            placed = placed.withColumn(f"_key_{k}", F.col(k).bitwiseXOR(F.lit(-(1 << 63))))
        for shift in range(0, widths[k].bit_length(), DIGIT):
            placed = stage(radix_pass(placed, f"_key_{k}", shift, bits), "op12-pass")
            bits = spans[0].bit_length() - BLOCK
    if not any(widths.values()):
        placed = stage(radix_pass(placed, f"_key_{keys[0]}", 0, bits), "op12-pass")
    return placed.withColumn("rank", F.col("place") + 1).drop("place", *[f"_key_{k}" for k in keys])


def resample(df: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row of (doc_id, text): n_features, weight, score and rank; of ``target`` only the texts count.

    Of the rows with at least ``least_words`` words the ``percent`` hundredths (rounded down) with the highest scores are drawn,
    ties to the smaller doc_id; their rank counts from 1, that of all others is null. A null text is empty:
    no features, weight 0. A null id draws like an empty one and comes after all ids. Rows that repeat an id are rows of their own;
    equal ones rank in either order. Without target texts, or with an empty target, gains follow from the corpus alone. An empty table gives no rows; extra columns are ignored.
    """
    rows = documents(df)
    aim = target.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gains = gains_of(bucket_counts(rows, buckets), bucket_counts(aim, buckets))
    scored = weights(rows, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    keyed = scored.select("*", (-F.col("score")).alias("rising"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    scored = stage(keyed, "op12-scores")
    able = F.col("n_words") >= least_words
    kept = scored.where(able)
    drawn = percent * kept.count() // 100
    ranked = radix_ranked(kept, ["rising", "none", "id"]).select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.union(scored.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
aims AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
runs AS (
  SELECT doc_id, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM docs),
aim_runs AS (
  SELECT unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM aims),
counted AS (SELECT doc_id, f, count(*) AS n FROM runs GROUP BY ALL),
totals AS (
  SELECT f, sum(s) AS s, sum(t) AS t
  FROM (SELECT f, n AS s, 0 AS t FROM counted UNION ALL SELECT f, 0, count(*) FROM aim_runs GROUP BY f) GROUP BY f),
entries AS (
  SELECT list(list_reduce(list_concat([i::BIGINT], range(8)::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
hashed AS (
  SELECT f, s, totals.t, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, entries.t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM totals, entries),
gains AS (
  SELECT bucket, floor(1000 * ln(((sum(t) + 1) * ((SELECT sum(s) FROM totals) + 10000))::DOUBLE / ((sum(s) + 1) * ((SELECT sum(t) FROM totals) + 10000))::DOUBLE))::BIGINT AS gain
  FROM hashed GROUP BY bucket),
weighed AS (
  SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM counted JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS among FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * among // 100 THEN place END AS rank FROM ranked
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
