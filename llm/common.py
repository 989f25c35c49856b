"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.session import scratch_dir, stage

__all__ = ["documents", "fold", "hashed_sample", "salted_join", "scratch_dir", "shuffle_width", "stage", "strings", "table", "texts_in_slices"]

#: ASCII white space as the contracts write it: blank and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and whole text; a null text counts as empty. Other columns, whatever their names, go."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold that is held out (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def texts_in_slices(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds at most ``max_bytes`` of text, or a single row beyond that."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column("text")).fill_null(0), dtype=np.int64)
        start, ends = 0, np.cumsum(sizes)
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def salted_join(rows: DataFrame, small: DataFrame, key: str, by: Column, salts: int = 32) -> DataFrame:
    """Left join with one row a key in ``small``, each repeated for every salt; ``by`` deals the rows of a hot key over the salts."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [key, "_salt"], "left").drop("_salt")


def hashed_sample(rows: DataFrame, key: str, most: int) -> list:
    """About ``most`` rows, those with the smallest hash of the key (all rows if there are fewer), in the order of the key.

    The cut follows from the count, so only what is kept reaches the driver; rows that repeat a key may add up to as many again.
    """
    n = rows.count()
    if n > most:
        rows = rows.where(F.xxhash64(key) < int(-(2**63) + 2**64 * (most / n)))
    return sorted(rows.limit(2 * most).collect(), key=lambda r: (r[key], str(r)))
