"""Catalogue metadata to typed DataFrames keyed by ``database, table``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.functions import coerce

KEY = ["database", "table"]

# What counts as a table to audit.
TABLE_TYPE = "BASE TABLE"
ENGINES = ("Doris", "OLAP")
SYSTEM_DATABASES = ("information_schema", "mysql", "performance_schema", "sys", "__internal_schema")

PROPERTY_PREFIX = "dynamic_partition."
SCAN_PROPERTIES = ("enable", "start", "end", "buckets", "time_unit", "prefix", "time_zone", "start_day_of_week")

_DDL_PROPERTY = r"""(?i)["'](dynamic_partition\.[^"']+)["']\s*=\s*["']([^"']*)["']"""


def like_pattern(text: str) -> str:
    """A search text without wildcards matches anywhere in the name."""
    wanted = text.strip()
    if not wanted:
        return "%"
    return wanted if "%" in wanted or "_" in wanted else f"%{wanted}%"


def candidates(tables: DataFrame, database: str = "", table_like: str = "", limit: int | None = None) -> DataFrame:
    """Tables to audit; with a limit the first in name order, one more than the limit so that a cut can be noticed."""
    rows = tables.where(
        (F.col("table_type") == TABLE_TYPE)
        & F.col("engine").isin(*ENGINES)
        & ~F.col("table_schema").isin(*SYSTEM_DATABASES)
    )
    if database.strip():
        rows = rows.where(F.col("table_schema") == database.strip())
    if table_like.strip():
        rows = rows.where(F.col("table_name").like(like_pattern(table_like)))
    rows = rows.select("table_schema", "table_name")
    return rows if limit is None else rows.orderBy("table_schema", "table_name").limit(limit + 1)


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-blank value among the columns that exist (names in any case)."""
    by_name = {c.lower(): c for c in df.columns}
    cols = [coerce.meta_trim(F.col(by_name[n]).cast("string")) for n in names if n in by_name]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(None).cast("string"))


def range_lower(text: Column) -> Column:
    """First key component of a partition range, quotes cut; ``''`` when there is none."""
    keys = F.regexp_extract(text, r"(?i)keys:\s*\[([^\]]+)\]", 1)
    first = coerce.meta_trim(F.substring_index(coerce.meta_trim(keys), ",", 1))
    return F.coalesce(coerce.meta_trim(F.btrim(first, F.lit("\"'"))), F.lit(""))


def typed_partitions(raw: DataFrame) -> DataFrame:
    """``database, table, pos, name, rows, data_size, buckets, empty, range_lower``.

    A partition is empty when both its row count and its size are known to be 0, or its size alone.
    """
    rows = coerce.loose_unsigned(first_present(raw, ["rowcount", "rows", "table_rows"]))
    size = coerce.byte_size(first_present(raw, ["datasize", "data_size", "data_length"]))
    typed = raw.select(
        *KEY,
        "pos",
        first_present(raw, ["partitionname", "partition_name", "partition", "name"]).alias("name"),
        rows.alias("_rows"),
        size.alias("_size"),
        F.coalesce(
            coerce.loose_unsigned(first_present(raw, ["buckets", "bucket_num", "bucketnum"])), F.lit(0)
        ).alias("buckets"),
        range_lower(first_present(raw, ["range"])).alias("range_lower"),
    )
    empty = (
        F.when(F.col("_rows").isNotNull() & F.col("_size").isNotNull(), (F.col("_rows") == 0) & (F.col("_size") == 0))
        .when(F.col("_size").isNotNull(), F.col("_size") == 0)
        .otherwise(F.lit(False))
    )
    zero = F.lit(0).cast("bigint")
    return typed.where(F.col("name").isNotNull()).select(
        *KEY,
        "pos",
        "name",
        F.coalesce("_rows", zero).alias("rows"),
        F.coalesce("_size", zero).alias("data_size"),
        "buckets",
        empty.alias("empty"),
        "range_lower",
    )


def partition_summary(partitions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Partition and empty-partition counts of the wanted tables."""
    key = ["table_schema", "table_name"]
    empty = (
        F.col("partition_name").isNotNull()
        & (F.col("data_length") == 0)
        & (F.col("table_rows").isNull() | (F.col("table_rows") == 0))
    )
    return (
        partitions.join(wanted.select(*key), key, "left_semi")
        .groupBy(*key)
        .agg(F.count("partition_name").alias("partition_count"), F.count_if(empty).alias("empty_partition_count"))
    )


def scan_properties(properties: DataFrame, wanted: DataFrame) -> DataFrame:
    """The eight dynamic-partition properties as columns."""
    key = ["table_schema", "table_name"]
    named = properties.where(F.startswith("property_name", F.lit(PROPERTY_PREFIX))).join(
        wanted.select(*key), key, "left_semi"
    )
    names = [PROPERTY_PREFIX + p for p in SCAN_PROPERTIES]
    wide = (
        named.withColumn("_name", F.lower("property_name")).groupBy(*key).pivot("_name", names).agg(F.max("property_value"))
    )
    return wide.select(*key, *[F.col(f"`{PROPERTY_PREFIX}{p}`").alias(f"dynamic_partition_{p}") for p in SCAN_PROPERTIES])


def property_map(columns: dict[str, Column]) -> Column:
    """Map of the non-blank properties; NULL when there is none."""
    pairs = [x for name, col in columns.items() for x in (F.lit(name), coerce.meta_trim(col))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v != "", F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


def catalogue_properties(properties: DataFrame | None, like: DataFrame) -> DataFrame:
    """``database, table, catalogue``: property map per table; no property table gives no rows."""
    if properties is None:
        return like.select(*KEY).limit(0).withColumn("catalogue", F.lit(None).cast("map<string,string>"))
    name = F.lower(coerce.meta_trim(F.col("property_name")))
    rows = properties.where(F.col("property_name").like(f"{PROPERTY_PREFIX}%")).select(
        F.col("table_schema").alias("database"),
        F.col("table_name").alias("table"),
        name.alias("name"),
        F.coalesce(coerce.meta_trim(F.col("property_value")), F.lit("")).alias("value"),
    )
    single = rows.groupBy(*KEY, "name").agg(F.max("value").alias("value"))
    # A table has a handful of distinct property names.
    return single.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("catalogue"))


def ddl_text(raw: DataFrame) -> DataFrame:
    """Table definitions; the text is in a named column or else in the one after the table's or view's name."""
    named = first_present(raw, ["create table", "create_table"])
    others = [c for c in raw.columns if c.lower() not in (*KEY, "view", "name")]
    if others:
        named = F.coalesce(named, F.nullif(coerce.meta_trim(F.col(f"`{others[0]}`")), F.lit("")))
    return raw.select(*KEY, named.alias("create_sql"))


def ddl_properties(ddl: Column) -> Column:
    """Dynamic-partition properties written in a table definition; a repeated one counts last."""
    names = F.transform(F.regexp_extract_all(ddl, F.lit(_DDL_PROPERTY), 1), lambda n: F.lower(coerce.meta_trim(n)))
    values = F.transform(F.regexp_extract_all(ddl, F.lit(_DDL_PROPERTY), 2), coerce.meta_trim)

    def last_only(found: Column) -> Column:
        kept = F.filter(
            F.sequence(F.lit(0), F.size(found["n"]) - 1),
            lambda i: F.array_position(F.slice(found["n"], i + 2, F.size(found["n"])), found["n"][i]) == 0,
        )
        kept = F.when(F.size(found["n"]) > 0, kept).otherwise(F.array().cast("array<int>"))
        return F.map_from_arrays(
            F.transform(kept, lambda i: found["n"][i]), F.transform(kept, lambda i: found["v"][i])
        )

    return coerce.once(F.struct(names.alias("n"), values.alias("v")), last_only)


def merged_properties(base: Column, override: Column) -> Column:
    """``base`` with the entries of ``override`` put over it."""
    empty = F.create_map().cast("map<string,string>")
    over = F.coalesce(override, empty)
    kept = F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.map_contains_key(over, k))
    return F.map_concat(kept, over)


def index_list(raw: DataFrame) -> DataFrame:
    """``database, table, pos, name, index_type, columns``: one row per index, in first-seen order."""
    rows = raw.select(
        *KEY,
        "pos",
        first_present(raw, ["key_name", "index_name", "indexname", "name"]).alias("name"),
        first_present(raw, ["index_type", "indextype", "type"]).alias("type"),
        first_present(raw, ["column_name", "columnname"]).alias("column"),
        coerce.loose_unsigned(first_present(raw, ["seq_in_index", "seqinindex", "seq"])).alias("seq"),
    ).where(F.col("name").isNotNull())
    columns = F.array_sort(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("pos", "seq", "column"))))
    grouped = rows.groupBy(*KEY, F.lower("name").alias("_key")).agg(
        F.min("pos").alias("pos"),
        F.min_by("name", "pos").alias("name"),
        F.min(F.when(F.col("type").isNotNull(), F.struct("pos", "type"))).alias("_type"),
        columns.alias("_columns"),
    )
    numbered = F.transform(
        F.col("_columns"),
        lambda c, i: F.struct(
            F.when(c["seq"] > 0, c["seq"]).otherwise((i + 1).cast("bigint")).alias("seq"), c["column"].alias("column"), i.alias("i")
        ),
    )
    names = F.transform(F.array_sort(numbered), lambda c: c["column"])
    distinct = coerce.once(names, lambda n: F.filter(n, lambda c, i: (i == 0) | (c != F.get(n, i - 1))))
    return grouped.select(
        *KEY, "pos", "name", F.coalesce(F.col("_type.type"), F.lit("")).alias("index_type"), distinct.alias("columns")
    )
