"""Share of resources per template, with the rest as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylens.operators.filters import QueryFilters, apply_filters, list_length
from querylens.operators.overview import with_zero_totals, workload_sums

RANK_KEYS = ("total_cpu_ms", "total_time_ms", "max_peak_mem_bytes")
OTHERS_KEY = "__others__"


def rank_key(metric: str, previous: str = "total_cpu_ms") -> str:
    """Ranking that goes with a metric: memory has its own, leaving it restores time or CPU."""
    if metric == "memory":
        return "max_peak_mem_bytes"
    if previous != "max_peak_mem_bytes":
        return previous
    return "total_time_ms" if metric == "time" else "total_cpu_ms"


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / F.nullif(whole, F.lit(0))).otherwise(F.lit(0.0))


def share_totals(records: DataFrame, filters: QueryFilters | None = None, dataset_id: str | None = None) -> DataFrame:
    sums = apply_filters(records, filters, dataset_id).agg(*workload_sums())
    return with_zero_totals(sums).withColumnRenamed("exec_count", "records")


def share(
    records: DataFrame,
    templates: DataFrame,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    n: int = 12,
    rank_by: str = "total_cpu_ms",
    metric: str | None = None,
) -> DataFrame:
    """Top templates and the residual row; nothing at all when no record passes the filters.

    The memory metric leaves the residual row out, as a maximum has no rest.
    """
    rank_by = rank_key(metric, rank_by) if metric else rank_by
    if rank_by not in RANK_KEYS:
        rank_by = "total_cpu_ms"
    keys = ["dataset_id", "stripped_template_id"]
    rows = apply_filters(records, filters, dataset_id)
    per_template = rows.groupBy(*keys).agg(*workload_sums(), F.max("peak_memory_bytes").alias("max_peak_mem_bytes"))
    totals = per_template.agg(
        F.coalesce(F.sum("exec_count"), F.lit(0)).alias("exec_count"),
        F.coalesce(F.sum("total_cpu_ms"), F.lit(0)).alias("total_cpu_ms"),
        F.coalesce(F.sum("total_time_ms"), F.lit(0)).alias("total_time_ms"),
    )
    top = with_zero_totals(
        per_template.join(templates.select(*keys, "sql_template_stripped"), keys)
        .orderBy(F.col(rank_by).desc_nulls_last(), "stripped_template_id")
        .limit(list_length(n))
    ).select(
        F.col("stripped_template_id").cast("string").alias("template_key"),
        F.col("sql_template_stripped").alias("template"),
        "exec_count",
        "total_cpu_ms",
        "total_time_ms",
        "max_peak_mem_bytes",
        F.lit(False).alias("is_others"),
    )
    result = top
    if metric != "memory":
        rest = [
            F.greatest(
                F.lit(0).cast("bigint"), totals.select(c).scalar() - F.coalesce(F.sum(c), F.lit(0))
            ).alias(c)
            for c in ("exec_count", "total_cpu_ms", "total_time_ms")
        ]
        others = (
            top.agg(*rest)
            .where(totals.select("exec_count").scalar() > 0)
            .select(
                F.lit(OTHERS_KEY).alias("template_key"),
                F.lit("Others").alias("template"),
                "exec_count",
                "total_cpu_ms",
                "total_time_ms",
                F.lit(None).cast("bigint").alias("max_peak_mem_bytes"),
                F.lit(True).alias("is_others"),
            )
        )
        result = top.unionByName(others)
    return result.select(
        "*",
        _ratio(F.col("total_cpu_ms"), totals.select("total_cpu_ms").scalar()).alias("cpu_share"),
        _ratio(F.col("total_time_ms"), totals.select("total_time_ms").scalar()).alias("time_share"),
    )
