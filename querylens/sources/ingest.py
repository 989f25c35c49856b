"""Log files of any supported format to the fact table, the template dimension and a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylens.functions.sqltext import DEFAULT_RULES, StrippingRule, has_template
from querylens.operators.dictionary import build_dictionary, encode_records
from querylens.ordering import Buckets, position
from querylens.schemas import PARSED_FIELDS
from querylens.session import stage
from querylens.sources import detect, fe_log, mysqldump, outfile
from querylens.sources.lines import LINES, read_lines

_COMMON = [
    *LINES.keys,
    "seq",
    "sub_seq",
    *PARSED_FIELDS,
    "queried_tables",
    "template",
    "parsed",
    "filtered",
]


@dataclass
class Ingested:
    """Fact rows, dimension rows, one report row per file, and malformed dump statements."""

    records: DataFrame
    templates: DataFrame
    report: DataFrame
    rejects: DataFrame


def _common(df: DataFrame, seq: str, sub_seq: Column, filtered: Column) -> DataFrame:
    queried = F.col("queried_tables") if "queried_tables" in df.columns else F.lit(None).cast("string")
    return df.select(
        *LINES.keys,
        F.col(seq).cast("bigint").alias("seq"),
        sub_seq.cast("int").alias("sub_seq"),
        *PARSED_FIELDS,
        queried.alias("queried_tables"),
        "template",
        F.lit(True).alias("parsed"),
        filtered.alias("filtered"),
    )


def number_records(accepted: DataFrame) -> DataFrame:
    """Consecutive ``record_id`` from 0 in file order, files in path order."""
    lanes = Buckets((), tuple(LINES.keys), ("seq", "sub_seq"))
    return position(accepted, lanes, "record_id").withColumn("record_id", F.col("record_id") - 1)


def ingest(
    spark: SparkSession,
    paths: str | Sequence[str],
    dataset_id: str = "default",
    tz: str = "UTC",
    formats: dict[str, tuple[str, str | None]] | None = None,
    rules: Sequence[StrippingRule] = DEFAULT_RULES,
) -> Ingested:
    """Read, parse and number the records of a set of files.

    ``formats`` maps file path to (format, delimiter) and saves the detection pass. The list of
    files is the only thing held on the driver, as it is by any Spark file source. ``rules`` say what
    is stripped from templates, in all formats alike. Parsed rows are
    staged once below ``spark.checkpoint.dir``: all results are built from that table.
    """
    if formats is None:
        found = detect.detect_formats(read_lines(spark, paths)).collect()
        formats = {r["file"]: (r["format"], r["delimiter"]) for r in found}
    by_format: dict[tuple[str, str | None], list[str]] = {}
    for file, key in sorted(formats.items()):
        by_format.setdefault(key, []).append(file)

    parts: list[DataFrame] = []
    inserts = None
    counters = None
    for (fmt, delimiter), files in by_format.items():
        if fmt == detect.FE_LOG:
            entries = stage(fe_log.read_fe_log(spark, files, tz, rules), "entries")
            parts.append(_common(fe_log.drop_slow_twins(entries), "record_seq", F.lit(0), F.lit(False)))
        elif fmt == detect.OUTFILE:
            rows = outfile.read_outfile(spark, files, delimiter or "\t", tz, rules)
            parts.append(_common(rows, "record_seq", F.lit(0), F.lit(False)))
        else:
            read = mysqldump.read_parts(spark, files)
            found = stage(mysqldump.parse_inserts(read), "inserts")
            rows = stage(mysqldump.tuple_records(read, tz, rules), "tuples")
            matched = found.groupBy("file").agg(F.count("*").alias("insert_statements_matched"), F.count("reason").alias("bad_statements"))
            parsed_tuples = rows.groupBy("file").agg(F.count("*").alias("tuples_parsed"))
            counted = mysqldump.statement_count(read).join(matched, "file", "left").join(parsed_tuples, "file", "left")
            # a dump may be found with or without a delimiter: both groups count
            inserts = found if inserts is None else inserts.union(found)
            counters = counted if counters is None else counters.unionByName(counted)
            parts.append(_common(rows, "statement_seq", F.col("tuple_pos"), F.col("is_noise")))
    if not parts:
        raise ValueError("no lines to ingest")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    parsed = stage(union, "parsed")

    stored = ~F.col("filtered") & has_template(F.col("template"))
    accepted = number_records(parsed.where(stored))
    accepted = stage(accepted, "accepted")
    dictionary = build_dictionary(accepted, dataset_id)
    records = encode_records(accepted, dictionary, dataset_id, PARSED_FIELDS)

    report = parsed.groupBy("file").agg(
        F.count("*").alias("records_parsed"),
        F.count_if(stored).alias("records_inserted"),
        F.count_if(~F.col("filtered") & ~has_template(F.col("template"))).alias("bad_records"),
        F.count_if(F.col("filtered")).alias("filtered_records"),
    )
    listing = spark.createDataFrame(
        [(f, k[0]) for f, k in sorted(formats.items())], "file string, format_detected string"
    )
    report = listing.join(report, "file", "left")
    zero = ["statements_scanned", "insert_statements_matched", "tuples_parsed", "bad_statements"]
    if counters is not None:
        report = report.join(counters, "file", "left")
    else:
        report = report.select("*", *[F.lit(0).cast("bigint").alias(c) for c in zero])
    report = report.fillna(0)
    no_rejects = spark.createDataFrame([], "file string, statement_seq bigint, reason string, snippet string, stopped_at string")
    return Ingested(
        records=records,
        templates=dictionary.drop("template_key"),
        report=report,
        rejects=mysqldump.rejects(inserts) if inserts is not None else no_rejects,
    )
