"""Full rule set for every table of a fleet in one job."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylens.ordering import carry_last
from querylens.schema_audit import rules
from querylens.schema_audit.ddl import descriptor_columns, non_key_columns
from querylens.schema_audit.findings import collected, score
from querylens.schema_audit.future import mark_future, window_columns
from querylens.schema_audit.inputs import KEY, catalogue_properties, ddl_properties, merged_properties
from querylens.schema_audit.timeline import ORDERED, counted, timeline, with_slices
from querylens.session import stage

SAMPLES = 5


def table_settings(
    ddl: DataFrame, properties: DataFrame | None, as_of: datetime, default_zone: str = "UTC"
) -> DataFrame:
    """One row per table: merged properties, window settings and what the definition says."""
    catalogue = catalogue_properties(properties, ddl)
    merged = ddl.join(catalogue, KEY, "left").withColumn(
        "properties", merged_properties(ddl_properties(F.col("create_sql")), F.col("catalogue"))
    )

    def text(name: str) -> Column:
        return F.try_element_at(F.col("properties"), F.lit(f"dynamic_partition.{name}"))

    columns = {
        **window_columns(F.col("properties"), as_of, default_zone),
        **descriptor_columns(F.col("create_sql")),
        **{f"dyn_{n}_text": text(n) for n in ("start", "end", "buckets")},
    }
    return merged.drop("catalogue").withColumns(columns)


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def empty_stats(marked: DataFrame) -> DataFrame:
    """Partition counts per table, with the future left out where *all* partitions can be placed.

    The range bounds decide if every one is readable, else the names, else nothing is left out.
    """
    empty = F.col("empty")
    stats = marked.groupBy(*KEY).agg(
        F.count("*").alias("total"),
        F.count_if(empty).alias("empty"),
        F.count("lower_us").alias("dated"),
        F.bool_and(F.col("range_future").isNotNull()).alias("_by_range"),
        F.bool_and(F.col("name_future").isNotNull()).alias("_by_name"),
        F.count_if(_flag("range_future")).alias("_range_all"),
        F.count_if(_flag("range_future") & empty).alias("_range_empty"),
        F.count_if(_flag("name_future")).alias("_name_all"),
        F.count_if(_flag("name_future") & empty).alias("_name_empty"),
        F.any_value("dyn_enabled").alias("_on"),
        F.any_value("dyn_end").alias("_end"),
    )
    by_range, by_name = F.col("_by_range"), F.col("_by_name")

    def chosen(kind: str) -> Column:
        return F.when(by_range, F.col(f"_range_{kind}")).when(by_name, F.col(f"_name_{kind}")).otherwise(0)

    unknown = F.coalesce(F.col("_on") & (F.col("_end") > 0), F.lit(False))
    return stats.select(
        *KEY,
        "total",
        "empty",
        "dated",
        (F.col("total") - chosen("all")).alias("eff_total"),
        (F.col("empty") - chosen("empty")).alias("eff_empty"),
        (by_range | by_name).alias("classified"),
        F.when(by_range, "partition_range")
        .when(by_name, "partition_name")
        .when(unknown, "unrecognized_no_exclusion")
        .otherwise("none")
        .alias("future_source"),
        F.when((F.col("total") <= 1) | (F.col("dated") == 0), "input_order")
        .when(F.col("dated") < F.col("total"), "range_lower_partial")
        .otherwise("range_lower")
        .alias("order_source"),
    )


def tail_stats(ordered: DataFrame, stats: DataFrame) -> DataFrame:
    """Empty tail per table, plain and with future partitions passed over."""
    placed = ordered.join(stats.select(*KEY, "classified", "future_source"), KEY)
    future = F.when(
        F.col("classified"),
        F.when(F.col("future_source") == "partition_range", _flag("range_future")).otherwise(_flag("name_future")),
    ).otherwise(F.lit(False))
    placed = placed.withColumn("_future", future)
    runs = counted(placed, {"_all_run": F.lit(1), "_now_run": ~F.col("_future")})
    tails = runs.groupBy(*KEY).agg(
        (F.count("*") - F.coalesce(F.max(F.when(~F.col("empty"), F.col("_all_run"))), F.lit(0))).alias("raw_tail"),
        (
            F.count_if(~F.col("_future"))
            - F.coalesce(F.max(F.when(~F.col("empty") & ~F.col("_future"), F.col("_now_run"))), F.lit(0))
        ).alias("_now_tail"),
        F.max_by("name", "ord").alias("latest_name"),
        F.any_value("classified").alias("_classified"),
        F.any_value("future_source").alias("_source"),
        F.any_value("dyn_enabled").alias("_on"),
    )
    looked = F.coalesce(F.col("_on"), F.lit(False)) & (F.col("raw_tail") > 0)
    return tails.select(
        *KEY,
        "raw_tail",
        F.when(looked, F.col("_now_tail")).otherwise(F.col("raw_tail")).alias("eff_tail"),
        F.when(looked, F.col("_source")).otherwise("none").alias("tail_source"),
        (looked & F.col("_classified")).alias("tail_classified"),
        "latest_name",
    )


def bucket_stats(partitions: DataFrame, cfg: rules.BucketConfig) -> DataFrame:
    """Bucket anomalies per table and tablet totals."""
    banded = partitions.withColumns(rules.bucket_band(F.col("data_size"), cfg))
    has_buckets = F.col("buckets") > 0
    valid = has_buckets & (F.col("data_size") > 0)
    kind = F.when(valid & (F.col("buckets") < F.col("lower_bound")), "too_small").when(
        valid & (F.col("buckets") > F.col("upper_bound")), "too_large"
    )
    banded = banded.withColumn("_kind", kind)
    return banded.groupBy(*KEY).agg(
        F.count_if(valid).alias("valid_count"),
        F.count_if(~has_buckets).alias("missing_buckets"),
        F.count_if(has_buckets & (F.col("data_size") == 0)).alias("missing_size"),
        F.count_if(F.col("_kind") == "too_small").alias("too_small"),
        F.count_if(F.col("_kind") == "too_large").alias("too_large"),
        F.sum(F.when(has_buckets, F.col("data_size")).cast("decimal(20,0)")).alias("total_bytes"),
        F.sum(F.when(has_buckets, F.col("buckets"))).alias("total_tablets"),
        F.count_if(has_buckets).alias("bucketed_count"),
    )


def first_samples(rows: DataFrame, order: str, text: Column, out: str) -> DataFrame:
    """Text of the first five rows per table; the limit is applied before rows are shuffled."""
    first = Window.partitionBy(*KEY).orderBy(order)
    top = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLES)
    listed = F.array_sort(F.collect_list(F.struct("_n", text.alias("_t"))))
    return top.groupBy(*KEY).agg(
        F.concat(F.lit("["), F.array_join(F.transform(listed, lambda r: r["_t"]), ","), F.lit("]")).alias(out)
    )


def anomaly_samples(partitions: DataFrame, cfg: rules.BucketConfig) -> tuple[DataFrame, DataFrame]:
    banded = partitions.withColumns(rules.bucket_band(F.col("data_size"), cfg)).where(
        (F.col("buckets") > 0) & (F.col("data_size") > 0)
    )
    text = F.to_json(
        F.struct(
            F.col("name").alias("partitionName"),
            F.col("buckets").alias("actualBuckets"),
            F.col("expected_min").alias("expectedMin"),
            F.col("expected_max").alias("expectedMax"),
            F.col("lower_bound").alias("lowerBound"),
            F.col("upper_bound").alias("upperBound"),
        )
    )
    small = banded.where(F.col("buckets") < F.col("lower_bound"))
    large = banded.where(F.col("buckets") > F.col("upper_bound"))
    return first_samples(small, "pos", text, "too_small_samples"), first_samples(large, "pos", text, "too_large_samples")


def bucket_jumps(ordered: DataFrame, tolerance: float) -> DataFrame:
    """Adjacent partitions whose bucket counts differ by more than the tolerance."""
    here = F.struct(F.col("name").alias("from_name"), F.col("buckets").alias("from_buckets"))
    paired = carry_last(with_slices(ordered), ORDERED, here, "_prev")
    before, now = F.col("_prev.from_buckets"), F.col("buckets")
    jump = (
        (before > 0)
        & (now > 0)
        & (before != now)
        & ((now > before * (1 + tolerance)) | (now < before * (1 - tolerance)))
    )
    return paired.where(jump).select(
        *KEY,
        "ord",
        F.col("_prev.from_name").alias("from_name"),
        F.col("name").alias("to_name"),
        before.alias("from_buckets"),
        now.alias("to_buckets"),
        (now / before).alias("ratio"),
    )


def jump_stats(jumps: DataFrame) -> DataFrame:
    text = F.to_json(
        F.struct(
            F.col("from_name").alias("fromPartition"),
            F.col("to_name").alias("toPartition"),
            F.col("from_buckets").alias("fromBuckets"),
            F.col("to_buckets").alias("toBuckets"),
            "ratio",
        )
    )
    return jumps.groupBy(*KEY).agg(F.count("*").alias("jumps")).join(
        first_samples(jumps, "ord", text, "jumps_samples"), KEY
    )


def schema_audit_detail(
    ddl: DataFrame,
    partitions: DataFrame,
    properties: DataFrame | None,
    as_of: datetime,
    default_zone: str = "UTC",
    config: rules.BucketConfig | None = None,
) -> DataFrame:
    """``database, table, total, findings, finding_count, score`` for every table in ``ddl``.

    Settings, classified partitions and the timeline each feed several rules, so they are written
    once below ``spark.checkpoint.dir``.
    """
    cfg = (config or rules.BucketConfig()).normalized()
    tables = stage(table_settings(ddl, properties, as_of, default_zone), "settings")
    marked = stage(mark_future(partitions, tables), "classified")
    stats = empty_stats(marked)
    ordered = stage(timeline(marked), "timeline")
    small, large = anomaly_samples(marked, cfg)
    facts = tables
    for part in (
        stats,
        tail_stats(ordered, stats),
        bucket_stats(marked, cfg),
        small,
        large,
        jump_stats(bucket_jumps(ordered, cfg.tolerance)),
    ):
        facts = facts.join(part, KEY, "left")
    counts = ["total", "empty", "eff_total", "eff_empty", "raw_tail", "eff_tail", "valid_count", "missing_buckets"]
    counts += ["missing_size", "too_small", "too_large", "total_tablets", "bucketed_count", "jumps"]
    facts = facts.fillna(0, subset=counts).fillna(False, subset=["classified", "tail_classified"])
    high, mostly = rules.empty_ratio_findings(scan=False)
    invalid = non_key_columns(F.col("dist_columns"), F.col("key_columns"))
    found = collected(
        high, rules.empty_tail_finding(), mostly, *rules.definition_findings(invalid), *rules.bucket_findings(cfg)
    )
    return (
        facts.select(*KEY, "create_sql", "properties", "total", found.alias("findings"))
        .withColumn("findings", rules.with_bucket_note(F.col("findings")))
        .withColumn("finding_count", F.size("findings"))
        .withColumn("score", score(F.col("findings")))
    )
