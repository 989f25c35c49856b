"""Writers: fact and dimension tables, delimited export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.functions.encode import tsv_field


#: Rows after which a task begins another file.
ROWS_PER_FILE = 4_000_000


def write_records(records: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replace the datasets present in ``records``.

    Rows are spread by dataset, time and record, so that a large dataset gets many files, each with a
    narrow time span for later skipping; the record id splits rows without time and those of one busy
    moment. ``partitions`` suits the size of the load; the default is the session's.
    """
    order = ["dataset_id", "event_time_ms", "record_id"]
    spread = records.repartitionByRange(partitions, *order) if partitions else records.repartitionByRange(*order)
    (
        spread.sortWithinPartitions(*order)
        .write.partitionBy("dataset_id")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_templates(templates: DataFrame, path: str) -> None:
    (
        templates.write.partitionBy("dataset_id")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def append_templates(templates: DataFrame, path: str) -> None:
    """Insert templates whose key is not there yet; existing rows stay as they are."""
    spark = templates.sparkSession
    key = ["dataset_id", "stripped_template_id"]
    existing = spark.read.schema(templates.schema).parquet(path).select(*key)
    templates.join(existing, key, "left_anti").write.partitionBy("dataset_id").mode("append").parquet(path)


def tsv_rows(df: DataFrame) -> DataFrame:
    """All columns as escaped export text."""
    return df.select(*[tsv_field(F.col(name), kind).alias(name) for name, kind in df.dtypes])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header line in every part file."""
    (
        tsv_rows(df)
        .write.option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("escape", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
