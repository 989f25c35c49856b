"""Newest slice of a live audit table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SECONDS = 3600


def lookback(
    table: DataFrame,
    as_of: datetime,
    seconds: int = DEFAULT_SECONDS,
    limit: int | None = None,
    time_column: str = "time",
    require_rows: bool = False,
    key: Sequence[str] = (),
) -> DataFrame:
    """All rows of the last ``seconds`` before ``as_of``, or the newest ``limit`` of them if the caller sets one.

    Rows of equal time are cut by ``key``, or by all columns. The range predicate reaches the source (Parquet row groups, JDBC). ``require_rows`` makes an
    empty slice an error, at the price of one extra job.
    """
    seconds = seconds if seconds > 0 else DEFAULT_SECONDS
    column = F.col(time_column)
    until = F.lit(as_of).cast(table.schema[time_column].dataType)
    since = until - F.expr(f"INTERVAL '{seconds}' SECOND")
    rows = table.where((column >= since) & (column <= until))
    if limit is not None and limit > 0:
        rows = rows.orderBy(column.desc(), *(key or [c for c in table.columns if c != time_column])).limit(limit)
    if require_rows and rows.isEmpty():
        raise ValueError("no audit rows found in the selected look-back window")
    return rows
