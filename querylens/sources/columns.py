"""Column names of the exported audit table, shared by the delimited and the dump reader."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from querylens.functions import coerce

# Column order of an export without header or column list (None: not used).
POSITIONAL: tuple[str | None, ...] = (
    "query_id", "time", "client_ip", "user_name", None, "db_name", "state", "error_code", "error_message",
    "query_time_ms", "scan_bytes", "scan_rows", "return_rows", None, None, None, None, None, None, None, None,
    "fe_ip", "cpu_time_ms", None, None, "peak_memory_bytes", "workload_group", "cloud_cluster_name", "stmt_raw",
)

# Header spellings of a delimited export.
EXPORT_ALIASES: dict[str, tuple[str, ...]] = {
    "query_id": ("query_id",),
    "time": ("time",),
    "client_ip": ("client_ip",),
    "user_name": ("user", "user_name"),
    "db_name": ("db", "db_name"),
    "state": ("state",),
    "error_code": ("error_code",),
    "error_message": ("error_message",),
    "query_time_ms": ("time(ms)", "time_ms", "query_time", "query_time_ms"),
    "scan_bytes": ("scan_bytes",),
    "scan_rows": ("scan_rows",),
    "return_rows": ("return_rows",),
    "fe_ip": ("fe_ip", "frontend_ip"),
    "cpu_time_ms": ("cpu_time_ms",),
    "peak_memory_bytes": ("peak_memory_bytes",),
    "workload_group": ("workload_group",),
    "cloud_cluster_name": ("cloud_cluster_name", "compute_group_name", "compute_group"),
    "stmt_raw": ("stmt", "stmt_raw"),
}

# Column-list spellings of a dump.
DUMP_ALIASES: dict[str, tuple[str, ...]] = {
    "is_internal": ("isinternal", "is_internal"),
    "query_id": ("queryid", "query_id"),
    "time": ("time",),
    "client_ip": ("client", "client_ip"),
    "user_name": ("user", "user_name"),
    "db_name": ("db", "db_name"),
    "state": ("state",),
    "error_code": ("errorcode", "error_code"),
    "error_message": ("errormessage", "error_message"),
    "query_time_ms": ("query_time", "query_time_ms", "time(ms)"),
    "scan_bytes": ("scan_bytes",),
    "scan_rows": ("scan_rows",),
    "return_rows": ("return_rows",),
    "fe_ip": ("fe_ip", "frontend_ip", "frontendip"),
    "cpu_time_ms": ("cpu_time_ms", "cputimems"),
    "peak_memory_bytes": ("peak_memory_bytes", "peakmemorybytes"),
    "workload_group": ("workload_group", "workloadgroup"),
    "cloud_cluster_name": (
        "cloud_cluster_name",
        "compute_group_name",
        "compute_group",
        "computegroupname",
        "computegroup",
    ),
    "stmt_raw": ("stmt", "stmt_raw"),
}

# A header line must name these columns.
REQUIRED_IN_HEADER = ("query_id", "time", "client_ip")


def field_keys(names: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """Canonical field of every column name, ``''`` where the name is unknown."""
    pairs = [F.lit(x) for key, words in aliases.items() for word in words for x in (word, key)]
    table = F.create_map(*pairs)
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(table, F.lower(coerce.trim(n))), F.lit("")))


FIELDS = tuple(DUMP_ALIASES)


def field_positions(keys: Column) -> Column:
    """1-based column of every one of ``FIELDS``, 0 where it is missing; the first column wins."""
    names = F.array(*[F.lit(f) for f in FIELDS])
    return coerce.once(keys, lambda k: F.transform(names, lambda f: F.array_position(k, f).cast("int")))


def default_positions() -> Column:
    return F.array(*[F.lit(POSITIONAL.index(f) + 1 if f in POSITIONAL else 0) for f in FIELDS])


def field_texts(values: Column, positions: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    """Decoded value of every one of ``FIELDS``; each step works on what the one before made of a value.

    One array expression a step instead of one expression per field: the generated code stays small
    enough for the JVM to compile it.
    """
    texts = coerce.once(values, lambda row: F.transform(positions, lambda p: F.get(row, p - 1)))
    for step in steps:
        texts = F.transform(texts, step)
    return texts


def named_texts(texts: str) -> list[Column]:
    return [F.col(texts)[i].alias(f) for i, f in enumerate(FIELDS)]


def typed_columns(tz: str) -> list[Column]:
    """Parsed record columns from text columns named like the fields, and ``_time`` digits."""
    numbers = ("query_time_ms", "cpu_time_ms", "scan_bytes", "scan_rows", "return_rows", "peak_memory_bytes")
    return [
        coerce.millis_of_digits(F.col("_time"), tz).alias("event_time_ms"),
        coerce.loose_bool(F.col("is_internal")).alias("is_internal"),
        "query_id",
        "user_name",
        coerce.client_address(F.col("client_ip")).alias("client_ip"),
        "fe_ip",
        "db_name",
        "state",
        coerce.prefix_int(F.col("error_code")).try_cast("int").alias("error_code"),
        "error_message",
        *[coerce.prefix_int(F.col(f)).alias(f) for f in numbers],
        "workload_group",
        "cloud_cluster_name",
        "stmt_raw",
    ]
