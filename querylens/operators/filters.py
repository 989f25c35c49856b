"""Predicates shared by all workload queries, and argument checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QueryFilters:
    """Blank or missing fields do not filter. Records with unknown origin count as not internal."""

    start_ms: int | None = None
    end_ms: int | None = None
    exclude_internal: bool = True
    user_name: str | None = None
    db_name: str | None = None
    client_ip: str | None = None
    state: str | None = None
    cloud_cluster_name: str | None = None

    def predicates(self) -> list[Column]:
        out = []
        for name in ("user_name", "db_name", "client_ip", "state", "cloud_cluster_name"):
            wanted = (getattr(self, name) or "").strip()
            if wanted:
                out.append(F.col(name) == wanted)
        if self.exclude_internal:
            out.append(~F.coalesce(F.col("is_internal"), F.lit(False)))
        if self.start_ms is not None:
            out.append(F.col("event_time_ms") >= self.start_ms)
        if self.end_ms is not None:
            out.append(F.col("event_time_ms") < self.end_ms)
        return out


ALL = QueryFilters(exclude_internal=False)


def apply_filters(
    records: DataFrame,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    template_id: int | None = None,
) -> DataFrame:
    out = records if dataset_id is None else records.where(F.col("dataset_id") == dataset_id)
    for predicate in (filters or QueryFilters()).predicates():
        out = out.where(predicate)
    if template_id is not None:
        out = out.where(F.col("stripped_template_id") == template_id)
    return out


def non_blank(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def list_length(n: float) -> int:
    """Length of a list as asked for; at least one row."""
    return max(1, math.floor(n))


def nulls_last(col: Column, descending: bool = False) -> Column:
    return col.desc_nulls_last() if descending else col.asc_nulls_last()


def failed() -> Column:
    """1 for a failed query: an error code, or any state other than EOF and OK (unknown included)."""
    code, state = F.col("error_code"), F.col("state")
    return F.when(code.isNotNull() & (code != 0), 1).when(state.isin("EOF", "OK"), 0).otherwise(1)


def search_templates(rows: DataFrame, text: str, column: str = "template") -> DataFrame:
    """Rows whose text contains the words searched for, in any case."""
    wanted = text.strip().lower()
    return rows.where(F.contains(F.lower(column), F.lit(wanted))) if wanted else rows
