"""Delimited export of the audit table (tab or comma), with or without a header line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions import coerce, encode, sqltext
from querylens.session import broadcast_if_small, stage
from querylens.sources.columns import (
    EXPORT_ALIASES,
    FIELDS,
    POSITIONAL,
    REQUIRED_IN_HEADER,
    default_positions,
    field_keys,
    field_positions,
    field_texts,
    named_texts,
    typed_columns,
)
from querylens.sources.lines import LINES, read_lines, without_cr

#: About what the header of a file takes in memory.
_HEADER_BYTES = 512


def header_positions(fields: Column) -> Column:
    """Columns of the known fields when the line is a header, else NULL."""

    def checked(positions: Column) -> Column:
        named = F.size(fields) >= 3
        for field in REQUIRED_IN_HEADER:
            named = named & (positions[FIELDS.index(field)] > 0)
        return F.when(named, positions)

    return coerce.once(field_positions(field_keys(fields, EXPORT_ALIASES)), checked)


def line_delimiter(line: Column) -> Column:
    """Tab or comma when the line is a header or has the full width, else NULL."""
    out = F.lit(None).cast("string")
    for delimiter in (",", "\t"):
        fields = encode.split_quoted(line, delimiter)
        fits = (F.size(fields) == len(POSITIONAL)) | header_positions(fields).isNotNull()
        out = F.when(F.coalesce(fits, F.lit(False)), F.lit(delimiter)).otherwise(out)
    return out


def header_lines(lines: DataFrame, delimiter: str) -> DataFrame:
    """First header line of every file that has one: ``file, h_split, h_line, h_positions``."""
    lowered = F.lower("value")
    possible = lines.where(
        F.contains(lowered, F.lit("query_id"))
        & F.contains(lowered, F.lit("time"))
        & F.contains(lowered, F.lit("client_ip"))
    )
    positions = header_positions(encode.split_quoted(F.col("value"), delimiter))
    found = possible.withColumn("positions", positions).where(F.col("positions").isNotNull())
    first = F.min(F.struct("split_start", "line_key", "positions"))
    return found.groupBy("file").agg(first.alias("h")).select(
        "file",
        F.col("h.split_start").alias("h_split"),
        F.col("h.line_key").alias("h_line"),
        F.col("h.positions").alias("h_positions"),
    )


def read_outfile(
    spark: SparkSession,
    paths: str | Sequence[str],
    delimiter: str = "\t",
    tz: str = "UTC",
    rules: Sequence[sqltext.StrippingRule] = sqltext.DEFAULT_RULES,
) -> DataFrame:
    """One row per data line. ``valid`` is false for lines of the wrong width or with an open quote.

    A header counts from its own line on: lines before it are read by position.
    """
    lines = without_cr(read_lines(spark, paths)).where(coerce.trim(F.col("value")) != "")
    # at most one row a file: lines stay where they were read, and a file's lines do not meet in one task
    headers = broadcast_if_small(stage(header_lines(lines, delimiter), "headers"), _HEADER_BYTES)
    joined = lines.join(headers, "file", "left")
    place = F.struct("split_start", "line_key")
    header_place = F.struct(F.col("h_split").alias("split_start"), F.col("h_line").alias("line_key"))
    after = F.coalesce(F.col("h_split").isNotNull() & (place > header_place), F.lit(False))
    is_header = F.coalesce(F.col("h_split").isNotNull() & (place == header_place), F.lit(False))
    split = joined.where(~is_header).select(
        "file",
        "split_start",
        "run",
        F.col("line_key").alias("record_seq"),
        encode.split_quoted(F.col("value"), delimiter).alias("_fields"),
        F.when(after, F.col("h_positions")).otherwise(default_positions()).alias("_positions"),
        after.alias("_named"),
    )
    wide_enough = F.when(F.col("_named"), F.size("_fields") >= F.array_max("_positions")).otherwise(
        F.size("_fields") == len(POSITIONAL)
    )
    split = split.withColumn("valid", F.col("_fields").isNotNull() & wide_enough)

    place_columns = [*LINES.keys, "record_seq", "valid"]
    decoded = field_texts(F.col("_fields"), F.col("_positions"), encode.EXPORT_STEPS)
    texts = split.withColumn("_texts", F.when(F.col("valid"), decoded)).select(*place_columns, *named_texts("_texts"))
    timed = texts.withColumn("_time", coerce.time_digits(F.col("time")))
    parsed = timed.select(*place_columns, *typed_columns(tz))
    return parsed.withColumn("template", sqltext.template_of(F.col("stmt_raw"), rules))
