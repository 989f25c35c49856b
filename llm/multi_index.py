"""Nearest neighbours by inner product, with multi-index hashing of learned binary codes.

Inner products become angles: rows get one more component that brings all to the largest norm, queries a
zero. Codes are the signs after rotations learned by iterative quantisation (each rotation is fitted, on a bounded
sample, to lose as little as possible between rotated rows and their signs); several rotations from
different starts make a code of CODE_BITS bits or more. Every code is cut into substrings of 8 bits, and a block of the index keeps, for each
substring, the rows of each of its 256 values.

A query probes, for t = 0, 1, ..., all values within distance t of each of its substrings. By the pigeonhole
principle that retrieves every code within Hamming radius m * (t + 1) - 1 of m substrings. The smallest radius
up to there that holds enough rows is then complete, and all rows within it are ranked by their inner products in double precision.

How many rows are enough follows from the data: codes tell less where norms differ much, so on a bounded sample
the share of rows is measured that a radius must hold to have the true neighbours of a bounded set of queries.

All rows are indexed, in blocks; the stated query set meets every block, in blocks of its own. A task holds one
block of either. For the ranking each block hands on its best k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import hashed_sample, stage, table

#: Bound on the rows that the rotations are fitted on.
SAMPLE = 8192
CODE_BITS = 256
FIT_ROUNDS = 25
#: The radius in a block must hold this share of its rows, and LEAST rows at least; the share grows until on the sample
#: RECALL of the neighbours of PROBES queries are within it.
SHARE, LEAST = 0.05, 128
RECALL, PROBES = 0.97, 256
#: Index blocks at most that are made for the sake of parallel work; fixed, so that results do not follow from the cluster.
SPREAD = 32
#: Components of an index block and of a query block.
INDEX_FLOATS, QUERY_FLOATS = 1 << 23, 1 << 21

_BY_DISTANCE = [np.array([v for v in range(256) if v.bit_count() == t], np.int64) for t in range(9)]


def widened(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with the component that brings them to the given norm."""
    return np.concatenate([x, np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))[:, None]], axis=1)


def rotations(sample: np.ndarray, norm: float, seed: int = 11) -> np.ndarray:
    """One matrix whose signs are the code; bits are a multiple of 8."""
    rows, draw = widened(sample, norm), np.random.default_rng(seed)
    d, found = rows.shape[1], []
    for _ in range(math.ceil(CODE_BITS / d)):
        turn = np.linalg.qr(draw.normal(size=(d, d)))[0]
        for _ in range(FIT_ROUNDS):
            left, _, right = np.linalg.svd(np.where(rows @ turn >= 0, 1.0, -1.0).T @ rows)
            turn = (left @ right).T
        found.append(turn)
    found = np.concatenate(found, axis=1)
    return found[:, : found.shape[1] // 8 * 8] if found.shape[1] >= CODE_BITS else found


def codes(rows: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Bytes of the code, which are its substrings."""
    return np.packbits(rows @ turn >= 0, axis=1)


class Index:
    """Substring tables of a block: rows in the order of each substring's value, and where each value begins."""

    def __init__(self, code: np.ndarray):
        self.code = code
        bits = code.shape[1]
        keyed = code.astype(np.int64) + np.arange(bits) * 256  # value of substring j at 256 j and on
        self.rows = np.argsort(code, axis=0, kind="stable").T.astype(np.int32).ravel()
        self.starts = np.concatenate([[0], np.bincount(keyed.ravel(), minlength=256 * bits).cumsum()])
        self.bases = np.arange(bits)[:, None] * 256

    def probe(self, query: np.ndarray, t: int) -> np.ndarray:
        """Rows with a substring at distance t, as often as they have one."""
        keys = ((query[:, None].astype(np.int64) ^ _BY_DISTANCE[t]) + self.bases).ravel()
        begin = self.starts[keys]
        sizes = self.starts[keys + 1] - begin
        ends = np.cumsum(sizes)
        return self.rows[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])]

    def within(self, query: np.ndarray, least: int) -> np.ndarray:
        """All rows within the smallest radius that holds at least ``least`` rows (all rows if there are fewer)."""
        m = len(query)
        seen = np.zeros(len(self.code), bool)
        for t in range(8):
            seen[self.probe(query, t)] = True
            near = np.flatnonzero(seen)
            if len(near) < least:
                continue
            distance = np.bitwise_count(self.code[near] ^ query).sum(1, dtype=np.int64)
            radius = np.partition(distance, least - 1)[least - 1]
            if radius <= m * (t + 1) - 1:
                return near[distance <= radius]
        return np.arange(len(self.code))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))[:k]


def needed_share(ids: np.ndarray, rows: np.ndarray, asks: list[tuple[int, np.ndarray]], norm: float, turn: np.ndarray, k: int) -> float:
    """The share of rows that a radius must hold to have RECALL of the k nearest rows of every ask.

    Of a larger table the k nearest are nearer still, so that a sample rather asks for too much.
    """
    code, shares = codes(widened(rows, norm), turn), [np.zeros(1)]
    for key, x in asks:
        distance = np.bitwise_count(code ^ codes(np.append(x, 0.0)[None], turn)).sum(1, dtype=np.int64)
        others = np.flatnonzero(ids != key)
        top = others[best((rows[others] * x).sum(1), ids[others], k)]
        shares.append((np.searchsorted(np.sort(distance), distance[top]) + 1) / len(ids))
    return float(np.quantile(np.concatenate(shares), RECALL, method="higher"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a finite vector other than zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def nearest(df: DataFrame, queries: str, k: int = 20, vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for every row that meets the SQL condition ``queries`` on vec_id.

    Nearness is the inner product; ties go to the smaller vec_id. Rows without id and vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor do vectors of another length than the most
    frequent one (the smaller of equally frequent ones). Rows with the query's own vec_id are not its
    candidates; of several rows with a query's id the smallest vector asks. Fewer than k candidates are all
    returned; an empty table or query set gives no rows. Extra columns are ignored. ``share``: of the rows
    of a block, how many are ranked at least; more are where the data asks for it (see ``needed_share``).
    """
    spark = df.sparkSession
    valid = stage(usable(df, vector), "op7-vectors")
    lengths = valid.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    most = lengths.orderBy(F.desc("n"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], result)
    d, n, norm = most["d"], most["n"], math.sqrt(most["norm"])
    rows = valid.where(F.size("v") == d)
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    q = asked.count()
    sample = hashed_sample(rows, "vec_id", SAMPLE)
    fitted = np.array([r["v"] for r in sample])
    turn = rotations(fitted, norm)
    asks = [(r["vec_id"], np.array(r["v"])) for r in hashed_sample(asked, "vec_id", PROBES)]
    share = max(share, needed_share(np.array([r["vec_id"] for r in sample]), fitted, asks, norm, turn, k))
    query_blocks = max(1, math.ceil(q * d / QUERY_FLOATS))
    spread = min(math.ceil(SPREAD / query_blocks), n // 4096)
    index_blocks = max(1, math.ceil(n * d / INDEX_FLOATS), spread)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    left = rows.select(dealt(index_blocks).alias("i"), every(query_blocks).alias("j"), "vec_id", "v")
    right = asked.select(every(index_blocks).alias("i"), dealt(query_blocks).alias("j"), "vec_id", "v")

    def run(index: pa.Table, wanted: pa.Table) -> pa.Table:
        out = [[], [], []]
        if index.num_rows and wanted.num_rows:
            ids, vectors = index.column("vec_id").to_numpy(), matrix(index.column("v"), d)
            asks = matrix(wanted.column("v"), d)
            tables = Index(codes(widened(vectors, norm), turn))
            ask_codes = codes(np.concatenate([asks, np.zeros((len(asks), 1))], axis=1), turn)
            least = max(LEAST, k + 1, math.ceil(len(ids) * share))
            for key, x, code in zip(wanted.column("vec_id").to_pylist(), asks, ask_codes):
                near = tables.within(code, least)
                near = near[ids[near] != key]
                scores = (vectors[near] * x).sum(1)
                top = best(scores, ids[near], k)
                out[0].append(np.full(len(top), key))
                out[1].append(ids[near][top])
                out[2].append(scores[top])
        columns = [np.concatenate([np.zeros(0, t), *c]) for c, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")
