"""Most expensive statement templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylens.operators.filters import QueryFilters, apply_filters, list_length, search_templates
from querylens.operators.overview import with_zero_totals, workload_sums
from querylens.operators.quantiles import approx_quantile, exact_quantiles

KEYS = ["dataset_id", "stripped_template_id"]


def top_sql(
    records: DataFrame,
    templates: DataFrame,
    filters: QueryFilters | None = None,
    dataset_id: str | None = None,
    n: int = 50,
    search: str = "",
    exact: bool = False,
) -> DataFrame:
    """Templates by total CPU time: aggregated, searched and cut before their texts are joined.

    ``rank`` counts among the templates whose text matches ``search``.
    """
    rows = apply_filters(records, filters, dataset_id)
    measures = [
        *workload_sums(),
        F.avg("query_time_ms").alias("avg_time_ms"),
        F.max("query_time_ms").alias("max_time_ms"),
        F.max("peak_memory_bytes").alias("max_peak_mem_bytes"),
    ]
    if not exact:
        measures.append(approx_quantile("query_time_ms", 0.95).alias("p95_time_ms"))
    sums = rows.groupBy(*KEYS).agg(*measures)
    order = [F.col("total_cpu_ms").desc_nulls_last(), F.col("stripped_template_id").asc()]
    matching = search_templates(templates, search, "sql_template_stripped").select(*KEYS)
    top = sums.join(matching, KEYS, "left_semi").orderBy(*order).limit(list_length(n)).join(templates, KEYS)
    if exact:
        listed = rows.join(top.select(*KEYS), KEYS, "left_semi")
        p95 = exact_quantiles(listed, KEYS, "query_time_ms", {"p95_time_ms": 0.95})
        top = top.join(p95, KEYS, "left")
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    out = with_zero_totals(ranked).fillna(0, subset=["avg_time_ms", "max_time_ms"])
    return out.select(
        "rank",
        F.col("stripped_template_id").alias("template_id"),
        F.col("sql_template_stripped").alias("template"),
        F.nullif("table_guess", F.lit("")).alias("table_guess"),
        "exec_count",
        "total_cpu_ms",
        "total_time_ms",
        "avg_time_ms",
        "max_time_ms",
        "p95_time_ms",
        "max_peak_mem_bytes",
    )
