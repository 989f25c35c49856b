"""Catalogue metadata derived from ``lineitem``: monthly partitions of some sixty tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import stored, table
from querylens.schema_audit.inputs import ddl_text, typed_partitions
from querylens.session import stage

# 2000-06-30 20:00 UTC is already July in Shanghai (tables with k = 4).
AS_OF = datetime(2000, 6, 30, 20, 0)

_BASE = {
    "tbl": "concat('t_', l_returnflag, l_linestatus, CAST(l_suppkey % 10 AS STRING))",
    "k": "CAST(l_suppkey % 10 AS INTEGER)",
    "idx": "CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER)",
    "qty": "l_quantity",
}
# Months without rows: one in five per table, and the newest ten of the tables with k in (3, 4).
_KEEP = "(idx * 7 + k) % 5 <> 0 AND NOT (k IN (3, 4) AND idx > {hi} - 10)"

_ROW = {
    "database": "CASE WHEN k < 5 THEN 'shop' ELSE 'stats' END",
    "table": "tbl",
    "pos": "CAST(CASE WHEN k % 2 = 0 THEN idx - lo ELSE hi - idx END AS INTEGER)",
    "name": "CASE WHEN k IN (1, 6) AND idx % 30 = 0 THEN concat('manual', CAST(idx AS STRING)) "
    "ELSE concat('p', CAST((idx - idx % 12) DIV_12 * 100 + idx % 12 + 1 AS STRING)) END",
    "rows": "CAST(coalesce(n, 0) AS BIGINT)",
    "data_size": "CAST(coalesce(qty, 0) * 33554432 AS BIGINT)",
    "buckets": "CAST(CASE WHEN k = 7 THEN 0 ELSE 1 + (idx % 12) * (k % 3) END AS BIGINT)",
    "range_lower": "CASE WHEN k % 4 = 0 OR (k % 4 = 1 AND idx % 2 = 0) THEN concat(CAST((idx - idx % 12) DIV_12 AS STRING), '-', "
    "lpad(CAST(idx % 12 + 1 AS STRING), 2, '0'), '-01 00:00:00') ELSE '' END",
}


def _spark(text: str) -> str:
    return text.replace("(idx - idx % 12) DIV_12", "(idx div 12)")


def _duck(text: str) -> str:
    return text.replace("(idx - idx % 12) DIV_12", "(idx // 12)")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per table and month, months without rows included."""
    base = table(spark, sf_dir, "lineitem").selectExpr(*[f"{sql} AS {name}" for name, sql in _BASE.items()])
    limits = base.agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    lo, hi = limits.select("lo").scalar(), limits.select("hi").scalar()
    kept = base.withColumn("hi", hi).where(F.expr(_KEEP.replace("{hi}", "hi")))
    sums = kept.groupBy("tbl", "idx").agg(F.count("*").alias("n"), F.floor(F.sum("qty")).alias("qty"))
    spine = base.select("tbl", "k").distinct().select(
        "tbl", "k", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(lo, hi)).alias("idx")
    )
    return spine.join(sums, ["tbl", "idx"], "left")


def raw_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a partition listing prints them: sizes with units, counts with commas, range texts."""
    rows = cells(spark, sf_dir).selectExpr("k", "qty", *[f"{_spark(sql)} AS `{name}`" for name, sql in _ROW.items()])
    quantity = F.coalesce("qty", F.lit(0)) * 32
    size = (
        F.when(F.col("k") % 3 == 0, F.col("data_size").cast("string"))
        .when(F.col("k") % 3 == 1, F.concat(F.format_number(quantity, 0), F.lit(" MB")))
        .otherwise(F.concat(quantity.cast("string"), F.lit(".0MiB")))
    )
    lower = F.when(
        F.col("range_lower") != "",
        F.concat(F.lit("[types: [DATETIMEV2]; keys: ['"), "range_lower", F.lit("', 7]; ..types: [DATETIMEV2]; keys: [x]; )")),
    )
    return rows.select(
        "database",
        "table",
        "pos",
        F.concat(F.lit(" "), "name").alias("PartitionName"),
        F.format_number("rows", 0).alias("RowCount"),
        size.alias("DataSize"),
        F.col("buckets").cast("string").alias("Buckets"),
        lower.alias("Range"),
    )


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "partitions", lambda: stage(typed_partitions(raw_partitions(spark, sf_dir)), "partitions"))


def table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``database, table, k``."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{_BASE['tbl']} AS tbl", f"{_BASE['k']} AS k").distinct()
    return rows.selectExpr(f"{_ROW['database']} AS database", "tbl AS `table`", "k")


def catalogue_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_list(spark, sf_dir).select(
        F.col("database").alias("table_schema"),
        F.col("table").alias("table_name"),
        F.when(F.col("k") == 9, "VIEW").otherwise("BASE TABLE").alias("table_type"),
        F.when(F.col("k") == 8, "MySQL").otherwise("OLAP").alias("engine"),
        "k",
    )


def catalogue_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions(spark, sf_dir).select(
        F.col("database").alias("table_schema"),
        F.col("table").alias("table_name"),
        F.col("name").alias("partition_name"),
        F.col("data_size").alias("data_length"),
        F.when(F.col("rows") > 0, F.col("rows")).alias("table_rows"),
    )


_PROPERTIES = {
    "Dynamic_Partition.enable": "'true'",
    "dynamic_partition.start": "CAST(-8 * k AS STRING)",
    "dynamic_partition.end": "concat(' ', CAST(k AS STRING))",
    "dynamic_partition.time_unit": "'month'",
    "dynamic_partition.prefix": "'p'",
    "dynamic_partition.time_zone": "CASE WHEN k = 4 THEN 'Asia/Shanghai' ELSE 'No/Where' END",
}


def catalogue_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even tables have a dynamic window; one more property has nothing to do with it."""
    names = {**_PROPERTIES, "replication_num": "'1'"}
    pairs = ", ".join(f"struct('{n.lower()}' AS property_name, {sql} AS property_value)" for n, sql in names.items())
    rows = table_list(spark, sf_dir).where("k % 2 = 0")
    return rows.selectExpr("database AS table_schema", "`table` AS table_name", f"inline(array({pairs}))")


_DDL = """concat('CREATE TABLE `t` (`k1` bigint, `k2` bigint) ENGINE=OLAP', chr(10), CASE k % 6
WHEN 0 THEN 'UNIQUE KEY(`k1`) DISTRIBUTED BY RANDOM BUCKETS 4'
WHEN 1 THEN 'unique  key (k1, `K2` ) distributed by hash(`k2`, k3) buckets 8'
WHEN 2 THEN 'AGGREGATE KEY(`k1`) DISTRIBUTED BY HASH(`k2`) BUCKETS AUTO'
WHEN 3 THEN 'DUPLICATE KEY(`k1`) DISTRIBUTED BY HASH(`k1`) BUCKETS AUTO'
WHEN 4 THEN 'AGGREGATE KEY(`k1`) DISTRIBUTED BY RANDOM BUCKETS AUTO'
ELSE 'DISTRIBUTED BY HASH(`k1`) BUCKETS 16' END, chr(10), 'PROPERTIES ("dynamic_partition.enable" = "', CASE WHEN k = 3 THEN 'TRUE' ELSE 'false' END,
'", "dynamic_partition.end"="', CAST(k AS STRING), '");')"""


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl_text(table_list(spark, sf_dir).selectExpr("database", "`table`", f"{_DDL} AS create_table"))


_duck_base = ", ".join(f"{sql} AS {name}" for name, sql in _BASE.items())
_duck_rows = ", ".join(f'{_duck(sql)} AS "{name}"' for name, sql in _ROW.items())

# Views ``p`` (typed partitions, with k and idx) and ``tl`` (tables).
PRELUDE = f"""WITH base AS (SELECT {_duck_base} FROM lineitem),
lim AS (SELECT min(idx) AS lo, max(idx) AS hi FROM base),
sums AS (SELECT tbl, idx, count(*) AS n, CAST(floor(sum(qty)) AS BIGINT) AS qty FROM base, lim WHERE {_KEEP.replace('{hi}', 'hi')} GROUP BY 1, 2),
spine AS (SELECT tbl, k, lo, hi, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS idx FROM (SELECT DISTINCT tbl, k FROM base), lim),
p AS (SELECT k, idx, {_duck_rows}, (coalesce(n, 0) = 0 AND coalesce(qty, 0) = 0) AS empty FROM spine LEFT JOIN sums USING (tbl, idx)),
tl AS (SELECT DISTINCT {_ROW['database']} AS database, tbl AS "table", k FROM base)
"""
