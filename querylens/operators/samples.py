"""Sample statements of one template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.operators.filters import QueryFilters, apply_filters, list_length

ORDER_KEYS = ("query_time_ms", "cpu_time_ms", "peak_memory_bytes")
_TEXT = ("query_id", "user_name", "db_name", "client_ip", "state", "stmt_raw")
COLUMNS = (
    "record_id",
    "event_time_ms",
    "query_id",
    "user_name",
    "db_name",
    "client_ip",
    "state",
    "query_time_ms",
    "cpu_time_ms",
    "peak_memory_bytes",
    "scan_bytes",
    "scan_rows",
    "return_rows",
    "stmt_raw",
)


def samples(
    records: DataFrame,
    template_id: int,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    limit: int = 50,
    order_by: str = "query_time_ms",
) -> DataFrame:
    """Costliest executions first, then newest, then latest read."""
    metric = order_by if order_by in ORDER_KEYS else "query_time_ms"
    rows = apply_filters(records, filters, dataset_id, template_id).select(*COLUMNS)
    top = rows.orderBy(
        F.col(metric).desc_nulls_last(), F.col("event_time_ms").desc_nulls_last(), F.col("record_id").desc()
    ).limit(list_length(limit))
    return top.select(*[F.nullif(c, F.lit("")).alias(c) if c in _TEXT else c for c in COLUMNS])
