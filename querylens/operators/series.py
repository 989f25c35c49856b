"""Time series of one template in equal buckets, without gaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.operators.filters import QueryFilters, apply_filters
from querylens.operators.overview import workload_sums

# Bucket widths in seconds that read well on an axis.
NICE_SECONDS = (60, 300, 900, 1800, 3600, 7200, 21600, 43200, 86400, 172800, 604800)


def nice_width_ms(at_least_ms: float) -> int:
    seconds = max(1, math.ceil(at_least_ms / 1000))
    for width in NICE_SECONDS:
        if width >= seconds:
            return width * 1000
    return max(1, math.ceil(seconds / 86400)) * 86400 * 1000


def plan_buckets(start_ms: int, end_ms: int, bucket_seconds: int, max_buckets: int | None = None) -> tuple[int, int, int]:
    """Width and edges (first start, end exclusive); wider than asked only to keep a maximum that the caller sets."""
    width = max(1, math.floor(bucket_seconds)) * 1000
    while True:
        first = start_ms // width * width
        last = -(-end_ms // width) * width
        if max_buckets is None or (last - first) // width <= max_buckets:
            return width, first, last
        width = nice_width_ms(math.ceil((last - first) / max_buckets))


def bucket_sums(rows: DataFrame, width_ms: int) -> DataFrame:
    start = (F.col("event_time_ms") - F.pmod("event_time_ms", F.lit(width_ms))).alias("bucket_ms")
    return rows.where(F.col("event_time_ms").isNotNull()).groupBy(start).agg(*workload_sums())


def template_series(
    records: DataFrame,
    template_id: int,
    bucket_seconds: int = 300,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    max_buckets: int | None = None,
) -> DataFrame:
    """``bucket_seconds, bucket_ms, bucket_start, exec_count, total_cpu_ms, total_time_ms``.

    One aggregated row (the time range) is read on the driver to lay out the buckets.
    """
    filters = filters or QueryFilters()
    rows = apply_filters(records, filters, dataset_id, template_id).where(F.col("event_time_ms").isNotNull())
    low, high = rows.agg(F.min("event_time_ms"), F.max("event_time_ms")).first()
    spark = records.sparkSession
    if low is None:
        width, first, last = max(1, math.floor(bucket_seconds)) * 1000, 0, 0
    else:
        start = filters.start_ms if filters.start_ms is not None else low
        end = filters.end_ms if filters.end_ms is not None else high + 1
        width, first, last = plan_buckets(start, end, bucket_seconds, max_buckets)
    spine = spark.range(first, last, width).withColumnRenamed("id", "bucket_ms")
    sums = bucket_sums(rows, width)
    return spine.join(sums, "bucket_ms", "left").select(
        F.lit(width // 1000).alias("bucket_seconds"),
        "bucket_ms",
        F.timestamp_millis("bucket_ms").alias("bucket_start"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exec_count", "total_cpu_ms", "total_time_ms")],
    )
