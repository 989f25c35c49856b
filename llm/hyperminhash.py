"""Near-duplicate documents by HyperMinHash sketches.

A document's set holds the 64-bit hashes of its distinct word shingles. For every bucket the
smallest 32-bit value under the bucket's own mixing is stored as a register: count of leading zeros (6
bits) and the 10 mantissa bits after the first one. Bands of 5 registers propose candidates; a pair
goes on when its Jaccard estimate, corrected for registers that agree by chance, lies within 4.5 standard
errors of the threshold; the full sets then decide. The number of bands follows from the threshold: a
pair exactly at it is missed with a probability below one in a million.

Equal sets are one node (named by a 64-bit digest of the set), so copies never become pairs. Nodes
are compared with the most central node of each bucket first; buckets that still hold several
components afterwards are compared in full, in blocks (see ``linking``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import SPACES, documents, stage, table, texts_in_slices
from llm.linking import components, members_of, open_members, star_pairs

BAND = 5
MANTISSA = 10
SLICE_BYTES = 2 << 20
MISS = 1e-6
DEVIATIONS = 4.5

U = np.uint64
_DRAW = np.random.default_rng(20240229)
#: A random odd value for every byte; capital ASCII letters have those of small ones.
_BYTE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in SPACES]] = True
_STEP = U(0x9E3779B97F4A7C15)
_PLACES = _DRAW.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_POWERS = np.cumprod(np.concatenate([[U(1)], np.full(4095, _STEP)]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets) of a string column without nulls."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per row); words are runs without ASCII white space, A-Z lower-cased."""
    rows = len(offsets) - 1
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = inside[starts]
    places = np.flatnonzero(inside)
    begins = np.flatnonzero(first[places])
    if not len(begins):
        return np.zeros(0, U), np.zeros(rows, np.int64)
    sizes = np.diff(np.append(begins, len(places)))
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.concatenate([[U(1)], np.full(longest - 1, _STEP)]), dtype=np.uint64)
    within = np.arange(len(places)) - np.repeat(begins, sizes)
    sums = np.add.reduceat(_BYTE[data[places]] * powers[within], begins)
    owner = np.searchsorted(offsets[1:], places[begins], side="right")
    return mix(sums + sizes.astype(U) * _STEP), np.bincount(owner, minlength=rows)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every row; fewer words are one shingle, no words none."""
    hashes, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    n = max(0, len(hashes) - words + 1)
    sums = np.zeros(n, U)
    for j in range(words):
        sums += hashes[j : j + n] * _PLACES[j]
    shingles = mix(sums)
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        if end - start >= words:
            yield np.unique(shingles[start : end - words + 1])
        elif end > start:
            few = hashes[start:end]
            yield mix((few * _PLACES[: len(few)]).sum(dtype=np.uint64, keepdims=True) + _POWERS[len(few) : len(few) + 1])
        else:
            yield hashes[:0]


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND))


@lru_cache(maxsize=4)
def mixers(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    return draw.integers(0, 1 << 32, buckets, dtype=np.uint32), draw.integers(0, 1 << 31, buckets, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """Leading zeros and mantissa of each bucket's smallest value."""
    flip, factor = mixers(buckets)
    low = np.full(buckets, 0xFFFFFFFF, np.uint32)
    small = (shingles >> U(32)).astype(np.uint32)
    for i in range(0, len(small), 4096):
        np.minimum(low, ((small[i : i + 4096, None] ^ flip) * factor).min(axis=0), out=low)
    part, power = np.frexp(low.astype(np.float64))
    mantissa = ((2 * part - 1) * (1 << MANTISSA)).clip(0).astype(np.uint16)
    return ((32 - power).astype(np.uint16) << MANTISSA) | mantissa


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, without the agreements to expect of unrelated sets of these sizes.

    Two unrelated minima share a register with probability 0.169919 * 2^-mantissa bits * 4q/(1+q)^2, q the ratio of sizes.
    """
    q = na / nb
    chance = 0.16991948715973910 * 2.0**-MANTISSA * 4 * q / (1 + q) ** 2
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    t = percent / 100
    return t - DEVIATIONS * math.sqrt(t * (1 - t) / (BAND * bands_for(percent)))


def sketches(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, registers); a row without shingles has neither node nor registers."""
    buckets = BAND * bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts_in_slices(batches, SLICE_BYTES):
            sizes, nodes, sketch = [], [], []
            for shingles in shingle_sets(*text_bytes(part.column("text")), words):
                sizes.append(len(shingles))
                nodes.append(int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None)
                sketch.append(registers(shingles, buckets).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "node", "registers"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, node long, registers binary")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose estimate is near the threshold or above."""
    least = least_estimate(percent)
    sides = [nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (register_rows(batch.column(f"r{x}")) for x in "ab")
                na, nb = (batch.column(f"n{x}").to_numpy().astype(float) for x in "ab")
                keep = (estimate(a, b, na, nb) >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def open_links(blocks: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed pairs (a, b) that join different components within a block, fewer than the block has rows.

    Pairs whose estimate passes are decided on their full sets here, where both are; pairs that earlier
    links have joined need no decision. A pair is taken in the bucket of the first band that both share.
    """
    least = least_estimate(percent)

    def run(group: pa.Table) -> pa.Table:
        node, label = (group.column(c).to_numpy() for c in ("node", "component"))
        label = label.copy()
        sizes, rows = group.column("n_shingles").to_numpy().astype(float), register_rows(group.column("registers"))
        held = [np.frombuffer(s, U) for s in group.column("members").to_pylist()]
        bands = np.ascontiguousarray(rows).view(f"V{2 * BAND}")
        own = int(np.argmax((bands == bands[0]).all(axis=0)))
        low, high = [], []
        for i in range(len(node) - 1):
            rest = slice(i + 1, None)
            fit = (label[rest] != label[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
            where = np.flatnonzero(fit) + i + 1
            if len(where):
                where = where[(estimate(rows[where], rows[i], sizes[where], sizes[i]) >= least) & (np.argmax(bands[where] == bands[i], axis=1) == own)]
            for j in where.tolist():
                if label[j] != label[i]:
                    shared = len(np.intersect1d(held[i], held[j], assume_unique=True))
                    if 100 * shared >= percent * (len(held[i]) + len(held[j]) - shared):
                        label[label == label[j]] = label[i]
                        low.append(min(node[i], node[j]))
                        high.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    joined = blocks.join(nodes.select("node", "n_shingles", "registers"), "node").join(sets, "node")
    return joined.groupBy("key", "block").applyInArrow(run, "a long, b long")


def node_sets(rows: DataFrame, sketched: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, set) of the wanted nodes: the whole texts of one document each are read again, and of all rows without id, as those cannot be told apart."""
    chosen = sketched.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    again = rows.join(chosen, "doc_id", "left_semi").union(rows.where("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in texts_in_slices(batches, SLICE_BYTES):
            sets = [s.tobytes() for s in shingle_sets(*text_bytes(part.column("text")), words)]
            nodes = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) if s else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "members"])

    return again.mapInArrow(run, "node long, members binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, component_id (smallest doc_id reachable) and kept.

    Two documents are linked when 100 * intersection >= percent * union of their sets of word shingles.
    Null or empty texts have no shingles and are linked with nothing: their component is their own id.
    Rows with equal sets are linked; rows that repeat an id are rows of one document. A row without id
    joins its group's component, or has none (null) if no row of the group has an id, and is not kept then
    unless it stands alone. Extra columns are ignored; an empty table gives no rows.
    """
    rows = documents(df)
    sketched = stage(sketches(rows, words, percent), "op2-sketches")
    shingled = sketched.where("node IS NOT NULL")
    nodes = stage(shingled.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "op2-nodes")
    width = 2 * BAND
    keys = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands_for(percent) - 1)), lambda i: F.xxhash64(i, F.substr("registers", i * width + 1, F.lit(width)))))
    members = members_of(nodes.select(keys.alias("key"), "node", F.col("n_shingles").alias("weight")), "op2-members")
    sets = stage(node_sets(rows, shingled.select("node", "doc_id"), members.select("node").distinct(), words), "op2-sets")
    edges = stage(confirmed(likely(star_pairs(members), nodes, percent), sets, percent), "op2-edges")
    found = components(edges, "op2-components")
    more = stage(open_links(open_members(members, found), nodes, sets, percent), "op2-edges")
    if more.take(1):
        found = components(edges.union(more), "op2-components")
    return labelled(sketched, found)


def labelled(sketched: DataFrame, found: DataFrame) -> DataFrame:
    least = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = least.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    names = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = grouped.join(names, "component").select("node", "component_id")
    out = sketched.drop("registers").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
