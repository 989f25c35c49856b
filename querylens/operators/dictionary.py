"""Template dictionary: numbers long template texts in first-seen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions.sqltext import table_guess, template_key
from querylens.ordering import dense_ids
from querylens.session import BROADCAST_BYTES, broadcast_if_small, stage

DISPLAY_CHARS = 4096
_CUT_MARK = " ...[truncated]"


def displayed_statement(stmt: Column) -> Column:
    """A statement shortened for lists. Stored statements and templates are always whole."""
    return F.when(F.length(stmt) > DISPLAY_CHARS, F.concat(F.left(stmt, F.lit(DISPLAY_CHARS)), F.lit(_CUT_MARK))).otherwise(stmt)


def build_dictionary(accepted: DataFrame, dataset_id: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``dataset_id, stripped_template_id, sql_template_stripped, table_guess, template_key``.

    ``accepted`` holds ``record_id, template, stmt_raw, db_name`` and optionally ``queried_tables``.
    The table guess is that of the first record of a template, so it is worked out for those
    records only. Grouping is by a key of fixed length with partial sums before the shuffle. The ids
    (two numbers per template) are staged and counted before they are broadcast to the records.
    """
    keyed = accepted.withColumn("template_key", template_key(F.col("template")))
    first = keyed.groupBy("template_key").agg(F.min("record_id").alias("record_id"))
    numbered = stage(
        dense_ids(first, "record_id", "stripped_template_id").select("record_id", "stripped_template_id"), "template-ids"
    )
    queried = F.col("queried_tables") if "queried_tables" in accepted.columns else None
    firsts = accepted.select("record_id", "template", "stmt_raw", "db_name", *(["queried_tables"] if queried is not None else []))
    found = firsts.join(broadcast_if_small(numbered, 16, broadcast_bytes), "record_id").select(
        F.lit(dataset_id).alias("dataset_id"),
        F.col("stripped_template_id").cast("int").alias("stripped_template_id"),
        F.col("template").alias("sql_template_stripped"),
        table_guess(F.col("stmt_raw"), F.col("db_name"), queried).alias("table_guess"),
        template_key(F.col("template")).alias("template_key"),
    )
    return stage(found, "templates")


def encode_records(
    accepted: DataFrame,
    dictionary: DataFrame,
    dataset_id: str,
    columns: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Replace the template text by its id, without moving the records while the dictionary is small."""
    ids = broadcast_if_small(dictionary.select("template_key", "stripped_template_id"), 100, broadcast_bytes)
    keyed = accepted.withColumn("template_key", template_key(F.col("template")))
    return keyed.join(ids, "template_key").select(
        F.lit(dataset_id).alias("dataset_id"),
        "record_id",
        *columns,
        "stripped_template_id",
    )
