"""Workload overview: key figures and the heaviest databases, users, addresses and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.functions.sqltext import table_name_parts
from querylens.operators.filters import QueryFilters, apply_filters, failed, non_blank
from querylens.operators.quantiles import approx_quantile, exact_quantiles

TOP = 20
DIMENSIONS = ("db_name", "user_name", "client_ip")
_DISTINCT = {
    "distinct_users": "user_name",
    "distinct_dbs": "db_name",
    "distinct_client_ips": "client_ip",
    "distinct_templates": "stripped_template_id",
}


def workload_sums() -> list[Column]:
    return [
        F.count("*").alias("exec_count"),
        F.sum("cpu_time_ms").alias("total_cpu_ms"),
        F.sum("query_time_ms").alias("total_time_ms"),
    ]


def with_zero_totals(df: DataFrame) -> DataFrame:
    """Totals without any value read 0; extremes and quantiles stay NULL."""
    return df.fillna(0, subset=["total_cpu_ms", "total_time_ms"])


def key_figures(
    records: DataFrame, filters: QueryFilters | None = None, dataset_id: str | None = None, exact: bool = False
) -> DataFrame:
    """One row. ``exact`` replaces the sketches for quantiles and distinct counts."""
    rows = apply_filters(records, filters, dataset_id)
    sums = [
        F.count("*").alias("records"),
        F.coalesce(F.sum("cpu_time_ms"), F.lit(0)).alias("total_cpu_ms"),
        F.coalesce(F.sum("query_time_ms"), F.lit(0)).alias("total_time_ms"),
        F.coalesce(F.sum(failed()), F.lit(0)).alias("failed_count"),
        F.min("event_time_ms").alias("min_time_ms"),
        F.max("event_time_ms").alias("max_time_ms"),
    ]
    if not exact:
        return rows.agg(
            *sums,
            approx_quantile("query_time_ms", 0.95).alias("p95_time_ms"),
            approx_quantile("query_time_ms", 0.99).alias("p99_time_ms"),
            *[F.approx_count_distinct(column).alias(name) for name, column in _DISTINCT.items()],
        )
    quantiles = exact_quantiles(rows, [], "query_time_ms", {"p95_time_ms": 0.95, "p99_time_ms": 0.99})
    distinct = rows.agg(*[F.count_distinct(column).alias(name) for name, column in _DISTINCT.items()])
    return rows.agg(*sums).select(
        "*",
        *[quantiles.select(name).scalar().alias(name) for name in ("p95_time_ms", "p99_time_ms")],
        *[distinct.select(name).scalar().alias(name) for name in _DISTINCT],
    )


def workload_rates(figures: DataFrame) -> DataFrame:
    """Duration, queries per second, failure ratio, mean concurrency and mean busy cores."""
    duration = F.greatest(F.col("max_time_ms") - F.col("min_time_ms"), F.lit(0))
    spans = duration > 0

    def per_ms(column: str) -> Column:
        return F.when(spans, F.col(column).cast("double") / F.nullif(duration, F.lit(0)))

    return figures.select(
        "*",
        duration.alias("duration_ms"),
        F.when(spans, F.col("records") / F.nullif(duration / 1000.0, F.lit(0.0))).alias("qps"),
        F.when(F.col("records") > 0, F.col("failed_count") / F.nullif("records", F.lit(0))).alias("failure_ratio"),
        per_ms("total_time_ms").alias("avg_concurrency"),
        per_ms("total_cpu_ms").alias("avg_cpu_cores"),
    )


def top_dimension(
    records: DataFrame, column: str, filters: QueryFilters | None = None, dataset_id: str | None = None, n: int = TOP
) -> DataFrame:
    rows = apply_filters(records, filters, dataset_id).where(non_blank(column))
    sums = rows.groupBy(F.col(column).alias("name")).agg(*workload_sums())
    return with_zero_totals(sums.orderBy(F.col("total_cpu_ms").desc_nulls_last(), "name").limit(n))


def top_dimensions(
    records: DataFrame, filters: QueryFilters | None = None, dataset_id: str | None = None, n: int = TOP
) -> DataFrame:
    """The three dimension lists in one pass: ``dimension, rank, name, ...``."""
    rows = apply_filters(records, filters, dataset_id)
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("name")) for d in DIMENSIONS])
    named = rows.select("cpu_time_ms", "query_time_ms", F.inline(pairs)).where(non_blank("name"))
    sums = named.groupBy("dimension", "name").agg(*workload_sums())
    by_cpu = Window.partitionBy("dimension").orderBy(F.col("total_cpu_ms").desc_nulls_last(), "name")
    return with_zero_totals(sums.withColumn("rank", F.row_number().over(by_cpu)).where(F.col("rank") <= n))


def top_tables(
    records: DataFrame,
    templates: DataFrame,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    n: int = TOP,
) -> DataFrame:
    """Heaviest tables. Facts shrink to one row per template before they meet the dimension."""
    keys = ["dataset_id", "stripped_template_id"]
    per_template = apply_filters(records, filters, dataset_id).groupBy(*keys).agg(*workload_sums())
    named = per_template.join(templates.where(non_blank("table_guess")).select(*keys, "table_guess"), keys)
    sums = named.groupBy("table_guess").agg(
        F.sum("exec_count").alias("exec_count"),
        F.sum("total_cpu_ms").alias("total_cpu_ms"),
        F.sum("total_time_ms").alias("total_time_ms"),
    )
    top = sums.orderBy(F.col("total_cpu_ms").desc_nulls_last(), "table_guess").limit(n)
    db, table = table_name_parts(F.col("table_guess"))
    return with_zero_totals(
        top.select(
            db.alias("db_name"), table.alias("table_name"), "exec_count", "total_cpu_ms", "total_time_ms"
        )
    )


def dimension_rates(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Queries per second and CPU share of every listed value."""
    rates = workload_rates(figures)
    seconds = rates.select("duration_ms").scalar() / 1000.0
    cpu = rates.select("total_cpu_ms").scalar()
    return rows.select(
        "*",
        F.when(seconds > 0, F.col("exec_count") / F.nullif(seconds, F.lit(0.0))).alias("qps"),
        F.when(cpu > 0, F.col("total_cpu_ms") / F.nullif(cpu, F.lit(0))).alias("cpu_share"),
    )


def data_range(figures: DataFrame) -> DataFrame:
    """Half-open time range that covers all data."""
    return figures.select(F.col("min_time_ms").alias("start_ms"), (F.col("max_time_ms") + 1).alias("end_ms"))
