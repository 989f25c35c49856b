"""Native server audit log: time-stamped entries of ``|Key=value`` pairs, statements may span lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querylens.functions import coerce, sqltext
from querylens.ordering import Buckets, assemble, carry_last
from querylens.sources.columns import typed_columns
from querylens.sources.lines import LINES, read_lines, without_cr

_S = coerce.SPACE
# How entries of the server log begin and name their keys.
_STAMP = rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_S}+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:[,.][0-9]{{3,6}})?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?"
RECORD_START = rf"^{_STAMP}(?:{_S}+\[[^\]]+\])?{_S}+"
_ENTRY = rf"(?s)^{_S}*({_STAMP}){_S}+(?:\[[^\]]+\])?{_S}*(.*)\z"
_KEY = r"\|([A-Za-z][A-Za-z0-9_().-]*)="

# Accepted spellings of every key, lower case, first hit wins.
KEY_ALIASES: dict[str, tuple[str, ...]] = {
    "timestamp": ("timestamp",),
    "is_internal": ("isinternal", "is_internal"),
    "query_id": ("queryid", "query_id"),
    "user_name": ("user", "user_name"),
    "client_ip": ("client", "client_ip"),
    "fe_ip": ("feip", "frontendip", "fe_ip", "frontend_ip"),
    "db_name": ("db", "db_name"),
    "state": ("state",),
    "error_code": ("errorcode", "error_code"),
    "error_message": ("errormessage", "error_message"),
    "query_time_ms": ("time(ms)",),
    "cpu_time_ms": ("cputimems",),
    "scan_bytes": ("scanbytes",),
    "scan_rows": ("scanrows",),
    "return_rows": ("returnrows",),
    "peak_memory_bytes": ("peakmemorybytes",),
    "workload_group": ("workloadgroup", "workload_group"),
    "cloud_cluster_name": (
        "cloudclustername",
        "cloud_cluster_name",
        "computegroupname",
        "compute_group_name",
        "computegroup",
        "compute_group",
    ),
    "queried_tables": ("queriedtablesandviews",),
    "stmt_raw": ("stmt",),
}


def is_record_start(line: Column) -> Column:
    return line.rlike(RECORD_START)


def record_blocks(lines: DataFrame, lead: bool = True) -> DataFrame:
    """``file, split_start, run, record_seq, text``: one row per log entry, continuation lines joined.

    Lines before the first entry of a file are one block. It holds no entry; without ``lead`` its lines
    are not put together and its text is NULL, however many they are.
    """
    starts = without_cr(lines).withColumn("is_start", is_record_start(F.col("value")))
    running = LINES.rows().rowsBetween(Window.unboundedPreceding, 0)
    numbered = starts.withColumn("local_seq", F.sum(F.col("is_start").cast("bigint")).over(running))
    return assemble(numbered, LINES, "value", "local_seq", "is_start", joiner="\n", lead=lead)


def key_values(body: Column, tail: Column) -> tuple[Column, Column]:
    """Lower-cased keys and their values, latest first, so that the first match is the last entry. ``tail``: the body trimmed, as a column."""
    closed = F.when(F.endswith(tail, F.lit("|")), F.left(tail, F.length(tail) - 1)).otherwise(tail)
    keys = F.split(F.lower(F.array_join(F.regexp_extract_all(body, F.lit(_KEY), 1), "|")), r"\|")
    pieces = F.split(closed, _KEY)
    values = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.reverse(keys), F.reverse(values)


_ALIASES = [(field, alias) for field, aliases in KEY_ALIASES.items() for alias in aliases]


def alias_values(keys: Column, values: Column) -> Column:
    """Trimmed value of every spelling in ``_ALIASES``, NULL where the key is missing."""
    names = F.array(*[F.lit(alias) for _, alias in _ALIASES])

    def all_aliases(entry: Column) -> Column:
        return F.transform(names, lambda alias: F.get(entry["values"], F.array_position(entry["keys"], alias).cast("int") - 1))

    found = coerce.once(F.struct(keys.alias("keys"), values.alias("values")), all_aliases)
    return F.transform(found, coerce.trimmed)


def parse_entries(blocks: DataFrame, tz: str = "UTC", rules: Sequence[sqltext.StrippingRule] = sqltext.DEFAULT_RULES) -> DataFrame:
    """Entry text to typed columns. Entries without a template cannot be stored."""
    body = F.regexp_extract("text", _ENTRY, 2)
    first_line = F.substring_index("text", "\n", 1)
    split = blocks.withColumn("text", F.coalesce("text", F.lit(""))).select(
        "*",
        F.regexp_extract("text", _ENTRY, 1).alias("_prefix_time"),
        F.contains(first_line, F.lit("[slow_query]")).alias("is_slow"),
        F.contains(first_line, F.lit("[query]")).alias("_query_tag"),
        coerce.non_blank(F.regexp_extract("text", r"\|QueryId=([^|]*)", 1)).alias("block_query_id"),
        body.alias("_body"),
    )
    split = split.withColumn("_tail", coerce.trimmed(F.col("_body")))
    keys, values = key_values(F.col("_body"), F.col("_tail"))
    split = split.withColumn("_found", alias_values(keys, values))

    def found(field: str) -> list[Column]:
        return [F.col("_found")[i] for i, (name, _) in enumerate(_ALIASES) if name == field]

    def text(field: str) -> Column:
        """First spelling with a value; a flag or statement counts even when it is blank, a number only if it can be read."""
        if field in ("is_internal", "stmt_raw"):
            return F.coalesce(*found(field))
        if field == "error_code":
            return F.coalesce(*[F.when(coerce.prefix_int(c).try_cast("int").isNotNull(), c) for c in found(field)])
        return F.coalesce(*[F.when(c != "", c) for c in found(field)])

    place = [*LINES.keys, "record_seq", "is_slow", "block_query_id"]
    texts = split.select(
        *place,
        (F.col("_query_tag") & ~F.col("is_slow")).alias("is_query"),
        F.col("_prefix_time"),
        *[text(field).alias(field) for field in KEY_ALIASES],
    )
    timed = texts.select(
        "*",
        coerce.time_digits(F.col("timestamp")).alias("_time"),
        coerce.time_digits(F.col("_prefix_time")).alias("_line_time"),
    )
    event_time, *others = typed_columns(tz)
    line_time = coerce.millis_of_digits(F.col("_line_time"), tz)
    parsed = timed.select(
        *place,
        "is_query",
        F.coalesce(event_time, line_time).alias("event_time_ms"),
        *others,
        "queried_tables",
        F.when(F.col("_prefix_time") != "", F.col("stmt_raw")).alias("_entry_stmt"),
    )
    return parsed.withColumn("template", sqltext.template_of(F.col("_entry_stmt"), rules)).drop("_entry_stmt")


# Entries of a file, bucketed by the run of lines their first line is in.
ENTRIES = Buckets(LINES.group, LINES.bucket, ("record_seq",))


def drop_slow_twins(entries: DataFrame) -> DataFrame:
    """Drop a slow-query entry that repeats the last stored query entry of its file."""
    stored_id = F.when(F.col("is_query") & sqltext.has_template(F.col("template")), F.col("query_id"))
    carried = carry_last(entries, ENTRIES, stored_id, "_last_query_id")
    twin = F.col("is_slow") & F.col("block_query_id").eqNullSafe(F.col("_last_query_id")) & F.col(
        "block_query_id"
    ).isNotNull()
    return carried.where(~twin).drop("_last_query_id")


def read_fe_log(
    spark: SparkSession, paths: str | Sequence[str], tz: str = "UTC", rules: Sequence[sqltext.StrippingRule] = sqltext.DEFAULT_RULES
) -> DataFrame:
    """All entries of the files, before slow-query twins are dropped."""
    return parse_entries(record_blocks(read_lines(spark, paths), lead=False), tz, rules)
