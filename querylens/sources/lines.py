"""Text lines with their place in the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.ordering import Buckets

# Lines are bucketed by runs inside the file split they were read from, as a compressed file is one split.
LINES = Buckets(("file",), ("split_start", "run"), ("line_key",))
#: A run holds at most 2 to this power lines.
RUN_BITS = 12
# Of a row's generated id, this many low bits count the rows of its task.
_ROW_BITS = 33


def _run(line_key: Column) -> Column:
    return F.shiftright(line_key.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)), RUN_BITS)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, split_start, run, line_key, value``; only ``\\n`` ends a line, a byte-order mark is dropped.

    Ascending ``(split_start, line_key)`` is the file order, and so is ``(split_start, run, line_key)``.
    """
    targets = [paths] if isinstance(paths, str) else list(paths)
    return (
        spark.read.text(targets, lineSep="\n")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("line_key"),
            F.col("value"),
        )
        .select("file", "split_start", _run(F.col("line_key")).alias("run"), "line_key", "value")
    )


def without_cr(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
