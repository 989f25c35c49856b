"""Who runs one template, from where, against which database."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylens.operators.filters import QueryFilters, apply_filters, list_length, non_blank
from querylens.operators.overview import DIMENSIONS, with_zero_totals, workload_sums
from querylens.operators.samples import samples
from querylens.operators.series import template_series

RANK_KEYS = ("total_cpu_ms", "total_time_ms", "exec_count")


def dimension_top(
    records: DataFrame,
    template_id: int,
    dimension: str = "user_name",
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    n: int = 10,
    rank_by: str = "total_cpu_ms",
) -> DataFrame:
    column = dimension if dimension in DIMENSIONS else "user_name"
    rank = rank_by if rank_by in RANK_KEYS else "total_cpu_ms"
    rows = apply_filters(records, filters, dataset_id, template_id).where(non_blank(column))
    sums = rows.groupBy(F.col(column).alias("name")).agg(*workload_sums())
    return with_zero_totals(
        sums.orderBy(F.col(rank).desc_nulls_last(), "name").limit(list_length(n))
    )


def dimension_tops(
    records: DataFrame,
    template_id: int,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    n: int = 10,
    rank_by: str = "total_cpu_ms",
) -> DataFrame:
    """All three dimensions of a template in one pass."""
    rank = rank_by if rank_by in RANK_KEYS else "total_cpu_ms"
    rows = apply_filters(records, filters, dataset_id, template_id)
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("name")) for d in DIMENSIONS])
    named = rows.select("cpu_time_ms", "query_time_ms", F.inline(pairs)).where(non_blank("name"))
    sums = named.groupBy("dimension", "name").agg(*workload_sums())
    order = Window.partitionBy("dimension").orderBy(F.col(rank).desc_nulls_last(), "name")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= list_length(n))
    return with_zero_totals(top)


@dataclass
class TemplateDetail:
    samples: DataFrame
    series: DataFrame
    dimensions: DataFrame


def template_detail(
    records: DataFrame,
    template_id: int,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    bucket_seconds: int = 300,
    order_by: str = "query_time_ms",
) -> TemplateDetail:
    """Everything a drill-down into one template shows."""
    return TemplateDetail(
        samples=samples(records, template_id, filters, dataset_id, order_by=order_by),
        series=template_series(records, template_id, bucket_seconds, filters, dataset_id),
        dimensions=dimension_tops(records, template_id, filters, dataset_id),
    )
