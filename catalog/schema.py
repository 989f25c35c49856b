"""Schema-audit queries over the derived catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import corpus_schema as corpus
from catalog.corpus_schema import AS_OF, PRELUDE, definitions, partitions
from catalog.registry import query, stored
from querylens.schema_audit import detail, findings, future, inputs, rules, scan, timeline
from querylens.schema_audit.ddl import descriptor_columns, non_key_columns
from querylens.session import stage

# June 2000, or July where the table's zone is ahead.
NOW_IDX = "CASE WHEN k = 4 THEN 24006 ELSE 24005 END"
ON = "(k % 2 = 0 OR k = 3)"
CLASSIFIED = "k IN (0, 2, 4, 8)"
FUTURE = f"({CLASSIFIED} AND idx > {NOW_IDX})"


def sql(text: str) -> str:
    return PRELUDE + text


def _settings(spark, sf):
    return stored(
        spark,
        sf,
        "settings",
        lambda: stage(detail.table_settings(definitions(spark, sf), corpus.catalogue_properties(spark, sf), AS_OF), "settings"),
    )


def _marked(spark, sf):
    return stored(
        spark, sf, "marked", lambda: stage(future.mark_future(partitions(spark, sf), _settings(spark, sf)), "marked")
    )


def _ordered(spark, sf):
    return stored(spark, sf, "ordered", lambda: stage(timeline.timeline(_marked(spark, sf)), "ordered"))


def _detail(spark, sf):
    def build():
        rows = detail.schema_audit_detail(
            definitions(spark, sf), partitions(spark, sf), corpus.catalogue_properties(spark, sf), AS_OF
        )
        return stage(rows, "detail")

    return stored(spark, sf, "detail", build)


@query(
    "src_25_candidates",
    sql("SELECT database AS table_schema, \"table\" AS table_name FROM tl WHERE k < 8"),
)
def src_25(spark, sf):
    return inputs.candidates(corpus.catalogue_tables(spark, sf))


@query(
    "flt_08_table_like",
    sql("SELECT database AS table_schema, \"table\" AS table_name FROM tl WHERE k < 8 AND database = 'shop' AND \"table\" LIKE '%F2%'"),
)
def flt_08(spark, sf):
    return inputs.candidates(corpus.catalogue_tables(spark, sf), " shop ", "F2")


@query(
    "src_26_partitions",
    sql('SELECT database, "table", pos, name, rows, data_size, buckets, empty, range_lower FROM p'),
)
def src_26(spark, sf):
    return inputs.typed_partitions(corpus.raw_partitions(spark, sf))


@query(
    "src_27_properties",
    sql(
        "SELECT database, \"table\", CAST(8 * (CASE WHEN k = 4 THEN 1 ELSE 0 END) + 6 - 8 * (CASE WHEN k = 4 THEN 1 ELSE 0 END) AS INTEGER) AS n, "
        "CAST(-8 * k AS VARCHAR) AS start, CAST(k AS VARCHAR) AS \"end\" FROM tl WHERE k % 2 = 0"
    ),
)
def src_27(spark, sf):
    rows = inputs.catalogue_properties(corpus.catalogue_properties(spark, sf), definitions(spark, sf))
    return rows.select(
        "database",
        "table",
        F.size("catalogue").alias("n"),
        F.col("catalogue")["dynamic_partition.start"].alias("start"),
        F.col("catalogue")["dynamic_partition.end"].alias("end"),
    )


@query(
    "join_07_property_override",
    sql(
        "SELECT database, \"table\", CASE WHEN k % 2 = 0 THEN 'true' WHEN k = 3 THEN 'TRUE' ELSE 'false' END AS enable, "
        f"{ON} AS dyn_enabled, CAST(CASE WHEN k % 2 = 0 THEN 9 * k + 1 END AS INTEGER) AS dyn_span FROM tl"
    ),
)
def join_07(spark, sf):
    return _settings(spark, sf).select(
        "database", "table", F.col("properties")["dynamic_partition.enable"].alias("enable"), "dyn_enabled", "dyn_span"
    )


@query(
    "str_19_ddl_descriptor",
    sql(
        "SELECT database, \"table\", CASE k % 6 WHEN 0 THEN 'unique' WHEN 1 THEN 'unique' WHEN 3 THEN 'duplicate' WHEN 5 THEN '' ELSE 'aggregate' END AS keys_type, "
        "CASE k % 6 WHEN 5 THEN '' WHEN 1 THEN 'k1,K2' ELSE 'k1' END AS key_columns, CASE WHEN k % 6 IN (0, 4) THEN 'random' ELSE 'hash' END AS distribution, "
        "CASE k % 6 WHEN 1 THEN 'k2,k3' WHEN 2 THEN 'k2' WHEN 3 THEN 'k1' WHEN 5 THEN 'k1' ELSE '' END AS dist_columns, k % 6 IN (2, 3, 4) AS auto_bucket, "
        "CAST(CASE k % 6 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 5 THEN 16 ELSE 0 END AS INTEGER) AS ddl_buckets, "
        "CASE k % 6 WHEN 1 THEN 'k3' WHEN 2 THEN 'k2' WHEN 5 THEN 'k1' ELSE '' END AS invalid FROM tl"
    ),
)
def str_19(spark, sf):
    rows = definitions(spark, sf).withColumns(descriptor_columns(F.col("create_sql")))
    invalid = non_key_columns(F.col("dist_columns"), F.col("key_columns"))
    return rows.withColumn("_invalid", invalid).select(
        "database",
        "table",
        "keys_type",
        F.array_join("key_columns", ",").alias("key_columns"),
        "distribution",
        F.array_join("dist_columns", ",").alias("dist_columns"),
        "auto_bucket",
        "ddl_buckets",
        F.array_join("_invalid", ",").alias("invalid"),
    )


SUMMARY = 'SELECT database, "table", k, count(*) AS total, count(*) FILTER (empty) AS empty FROM p WHERE k < 8 GROUP BY 1, 2, 3'


@query(
    "agg_15_partition_summary",
    sql(f'SELECT database AS table_schema, "table" AS table_name, total AS partition_count, empty AS empty_partition_count FROM ({SUMMARY})'),
)
def agg_15(spark, sf):
    wanted = inputs.candidates(corpus.catalogue_tables(spark, sf))
    return inputs.partition_summary(corpus.catalogue_partitions(spark, sf), wanted)


@query(
    "agg_16_property_pivot",
    sql(
        "SELECT database AS table_schema, \"table\" AS table_name, 'true' AS enable, CAST(-8 * k AS VARCHAR) AS start, ' ' || k AS \"end\", "
        "'month' AS time_unit FROM tl WHERE k % 2 = 0 AND k < 8"
    ),
)
def agg_16(spark, sf):
    wanted = inputs.candidates(corpus.catalogue_tables(spark, sf))
    rows = inputs.scan_properties(corpus.catalogue_properties(spark, sf), wanted)
    names = ("enable", "start", "end", "time_unit")
    return rows.select("table_schema", "table_name", *[F.col(f"dynamic_partition_{n}").alias(n) for n in names])


def _clamped(x: str, low: float) -> str:
    return f"least(1.0::DOUBLE, greatest({low}::DOUBLE, {x}))"


# Scan items: only the empty-ratio rules apply; the window of a dynamic table reaches into the future when k > 0.
_COVER = "CASE WHEN total >= 16 THEN 1.0::DOUBLE ELSE 0.55 + 0.45 * total / 16.0::DOUBLE END"
_E = f"least(0.95::DOUBLE, (CASE WHEN ratio >= 0.6 THEN 1.0 ELSE 0.7 END)::DOUBLE * 0.95::DOUBLE * {_clamped('0.25 + 0.75 * ratio', 0.25)} * (CASE WHEN k % 2 = 0 AND k > 0 THEN 0.75 ELSE 0.95 END)::DOUBLE * {_COVER})"
_W = "(CASE WHEN span <= 32 THEN 0.8 WHEN span >= 64 THEN 1.0 ELSE 0.8 + 0.2 * (span - 32) / 32.0 END)::DOUBLE"
_D = f"least(0.95::DOUBLE, 0.7::DOUBLE * 0.85::DOUBLE * {_clamped('(' + _clamped('0.30 + 0.70 * ratio', 0.30) + ') * ' + _W, 0.35)} * (CASE WHEN k > 0 THEN 0.65 ELSE 0.9 END)::DOUBLE * {_COVER})"
ITEMS = (
    f", s AS ({SUMMARY}), r AS (SELECT *, empty / total::DOUBLE AS ratio, 9 * k + 1 AS span FROM s), "
    f"c AS (SELECT *, CASE WHEN ratio >= 0.3 THEN {_E} ELSE 0 END AS e, CASE WHEN k % 2 = 0 AND ratio >= 0.6 THEN {_D} ELSE 0 END AS d FROM r), "
    'items AS (SELECT database, "table", total AS partition_count, empty AS empty_partition_count, round(ratio, 9) AS empty_partition_ratio, '
    "k % 2 = 0 AS dynamic_partition_enabled, CAST(round((1 - (1 - e) * (1 - d)) * 100) AS INTEGER) AS score, "
    "CAST((e > 0)::INT + (d > 0)::INT AS INTEGER) AS finding_count FROM c) "
)
ITEM_COLUMNS = ["database", "table", "partition_count", "empty_partition_count", "empty_partition_ratio"]
ITEM_COLUMNS += ["dynamic_partition_enabled", "score", "finding_count"]


def _scan(spark, sf, **options):
    return scan.schema_audit_scan(
        corpus.catalogue_tables(spark, sf),
        corpus.catalogue_partitions(spark, sf),
        corpus.catalogue_properties(spark, sf),
        AS_OF,
        **options,
    )


def _items(df):
    return df.select(*ITEM_COLUMNS).withColumn("empty_partition_ratio", F.round("empty_partition_ratio", 9))


@query("rule_scan_items", sql(ITEMS + "SELECT * FROM items"))
def rule_scan(spark, sf):
    tables, parts, props = (
        corpus.catalogue_tables(spark, sf),
        corpus.catalogue_partitions(spark, sf),
        corpus.catalogue_properties(spark, sf),
    )
    return _items(scan.scan_items(scan.scan_rows(tables, parts, props), AS_OF))


@query(
    "sort_07_scan_page",
    sql(ITEMS + 'SELECT * FROM items ORDER BY score DESC, finding_count DESC, database, "table" OFFSET 10 LIMIT 10'),
)
def sort_07(spark, sf):
    return _items(_scan(spark, sf, page=2, page_size=10).items)


@query(
    "sort_08_scan_truncated",
    # of one candidate too many in name order, the least risky one goes
    sql(
        ', cand AS (SELECT database, "table" FROM tl WHERE k < 8 ORDER BY 1, 2 LIMIT 21)'
        + ITEMS.replace(SUMMARY, f'SELECT x.* FROM ({SUMMARY}) x SEMI JOIN cand USING (database, "table")')
        + "SELECT items.* FROM items JOIN s USING (database, \"table\") "
        "ORDER BY s.empty / s.total::DOUBLE DESC, s.empty DESC, dynamic_partition_enabled DESC, database, \"table\" LIMIT 20"
    ),
)
def sort_08(spark, sf):
    return _items(_scan(spark, sf, limit=20, page_size=200).items)


@query(
    "agg_17_inventory",
    sql(
        ITEMS + "SELECT count(DISTINCT database) AS database_count, count(*) AS table_count, count(*) FILTER (partition_count > 0) AS partitioned_table_count, "
        "CAST(sum(partition_count) AS BIGINT) AS total_partition_count, CAST(sum(empty_partition_count) AS BIGINT) AS empty_partition_count, "
        "round(sum(empty_partition_count) / sum(partition_count), 9) AS empty_partition_ratio, count(*) FILTER (dynamic_partition_enabled) AS dynamic_partition_table_count FROM items"
    ),
)
def agg_17(spark, sf):
    return _scan(spark, sf).inventory.withColumn("empty_partition_ratio", F.round("empty_partition_ratio", 9))


@query(
    "dt_01_lower_bound",
    sql("SELECT database, \"table\", pos, CASE WHEN range_lower <> '' THEN epoch_us(CAST(range_lower AS TIMESTAMP)) END AS lower_us FROM p"),
)
def dt_01(spark, sf):
    return partitions(spark, sf).select("database", "table", "pos", future.lower_bound_us(F.col("range_lower")).alias("lower_us"))


@query(
    "dt_02_future_partitions",
    sql(
        f"SELECT database, \"table\", pos, CASE WHEN k % 2 = 0 AND range_lower <> '' THEN idx > {NOW_IDX} END AS range_future, "
        f"CASE WHEN k % 2 = 0 AND name LIKE 'p%' THEN idx > {NOW_IDX} END AS name_future FROM p"
    ),
)
def dt_02(spark, sf):
    return _marked(spark, sf).select("database", "table", "pos", "range_future", "name_future")


@query(
    "agg_21_effective_empty",
    sql(
        f"SELECT database, \"table\", count(*) - count(*) FILTER ({FUTURE}) AS eff_total, count(*) FILTER (empty) - count(*) FILTER (empty AND {FUTURE}) AS eff_empty, "
        f"any_value({CLASSIFIED}) AS classified, CASE WHEN any_value(k) IN (0, 4, 8) THEN 'partition_range' WHEN any_value(k) = 2 THEN 'partition_name' "
        "WHEN any_value(k) IN (3, 6) THEN 'unrecognized_no_exclusion' ELSE 'none' END AS future_source, "
        "CASE any_value(k) % 4 WHEN 0 THEN 'range_lower' WHEN 1 THEN 'range_lower_partial' ELSE 'input_order' END AS order_source FROM p GROUP BY 1, 2"
    ),
)
def agg_21(spark, sf):
    return detail.empty_stats(_marked(spark, sf)).select(
        "database", "table", "eff_total", "eff_empty", "classified", "future_source", "order_source"
    )


TIMELINE = (
    ", dated AS (SELECT *, row_number() OVER (PARTITION BY database, \"table\" ORDER BY range_lower, name, pos) AS by_time, "
    "row_number() OVER (PARTITION BY database, \"table\" ORDER BY pos) AS by_place FROM p WHERE range_lower <> ''), "
    'moved AS (SELECT a.database, a."table", a.pos, b.pos AS ord FROM dated a JOIN dated b ON a.database = b.database AND a."table" = b."table" AND a.by_time = b.by_place), '
    'o AS (SELECT p.*, coalesce(moved.ord, p.pos) AS ord FROM p LEFT JOIN moved USING (database, "table", pos)) '
)


@query("win_04_timeline", sql(TIMELINE + 'SELECT database, "table", pos, name, ord FROM o'))
def win_04(spark, sf):
    return _ordered(spark, sf).select("database", "table", "pos", "name", "ord")


@query(
    "win_05_empty_tail",
    sql(
        TIMELINE
        + f", f AS (SELECT *, {FUTURE} AS future FROM o), m AS (SELECT database, \"table\", max(ord) FILTER (NOT empty) AS last_full, "
        "max(ord) FILTER (NOT empty AND NOT future) AS last_now FROM f GROUP BY 1, 2) "
        "SELECT database, \"table\", raw_tail, CASE WHEN on_ AND raw_tail > 0 THEN now_tail ELSE raw_tail END AS eff_tail, latest_name FROM ("
        f"SELECT f.database, f.\"table\", count(*) FILTER (ord > coalesce(last_full, -1)) AS raw_tail, "
        f"count(*) FILTER (ord > coalesce(last_now, -1) AND NOT future) AS now_tail, any_value({ON}) AS on_, arg_max(name, ord) AS latest_name "
        'FROM f JOIN m USING (database, "table") GROUP BY 1, 2)'
    ),
)
def win_05(spark, sf):
    stats = detail.empty_stats(_marked(spark, sf))
    return detail.tail_stats(_ordered(spark, sf), stats).select("database", "table", "raw_tail", "eff_tail", "latest_name")


@query(
    "win_07_bucket_jumps",
    sql(
        TIMELINE
        + ', l AS (SELECT *, lag(name) OVER w AS from_name, lag(buckets) OVER w AS from_buckets FROM o WINDOW w AS (PARTITION BY database, "table" ORDER BY ord)) '
        'SELECT database, "table", from_name, name AS to_name, from_buckets, buckets AS to_buckets FROM l '
        "WHERE from_buckets > 0 AND buckets > 0 AND buckets <> from_buckets AND (buckets > from_buckets * 1.5 OR buckets < from_buckets * 0.5)"
    ),
)
def win_07(spark, sf):
    return detail.bucket_jumps(_ordered(spark, sf), 0.5).drop("ord", "ratio")


_EST = "CASE WHEN data_size <= 104857600 THEN 1 WHEN data_size <= 1073741824 THEN 2 ELSE least(128, ceil(data_size / ({g} * 1073741824.0::DOUBLE))) END"
BAND = (
    f", e AS (SELECT *, {_EST.format(g=5)} AS classic, {_EST.format(g=10)} AS shared FROM p), "
    "b AS (SELECT *, CAST(least(classic, shared) AS INTEGER) AS expected_min, CAST(greatest(classic, shared) AS INTEGER) AS expected_max FROM e), "
    "band AS (SELECT *, CAST(greatest(1, floor(expected_min * 0.5)) AS INTEGER) AS lower_bound, "
    "CAST(least(128, greatest(ceil(expected_max * 1.5), greatest(1, floor(expected_min * 0.5)))) AS INTEGER) AS upper_bound FROM b) "
)


@query(
    "math_02_bucket_band",
    sql(BAND + 'SELECT database, "table", pos, expected_min, expected_max, lower_bound, upper_bound FROM band'),
)
def math_02(spark, sf):
    cfg = rules.BucketConfig().normalized()
    return partitions(spark, sf).select(
        "database", "table", "pos", *[c.alias(n) for n, c in rules.bucket_band(F.col("data_size"), cfg).items()]
    )


VALID = "buckets > 0 AND data_size > 0"


@query(
    "agg_20_bucket_anomalies",
    sql(
        BAND
        + f'SELECT database, "table", count(*) FILTER ({VALID}) AS valid_count, count(*) FILTER (buckets <= 0) AS missing_buckets, '
        "count(*) FILTER (buckets > 0 AND data_size = 0) AS missing_size, "
        f"count(*) FILTER ({VALID} AND buckets < lower_bound) AS too_small, count(*) FILTER ({VALID} AND buckets > upper_bound) AS too_large FROM band GROUP BY 1, 2"
    ),
)
def agg_20(spark, sf):
    rows = detail.bucket_stats(partitions(spark, sf), rules.BucketConfig().normalized())
    return rows.select("database", "table", "valid_count", "missing_buckets", "missing_size", "too_small", "too_large")


@query(
    "agg_19_tablet_layout",
    sql(
        'SELECT database, "table", CAST(sum(data_size) FILTER (buckets > 0) AS BIGINT) AS total_bytes, '
        "CAST(sum(buckets) FILTER (buckets > 0) AS BIGINT) AS total_tablets, count(*) FILTER (buckets > 0) AS bucketed_count FROM p GROUP BY 1, 2"
    ),
)
def agg_19(spark, sf):
    rows = detail.bucket_stats(partitions(spark, sf), rules.BucketConfig().normalized())
    return rows.select("database", "table", F.col("total_bytes").cast("bigint").alias("total_bytes"), "total_tablets", "bucketed_count")


# Every order is a row of some index of one of 40 tables: names differ in case, types and numbers are partly absent.
_INDEX_ROWS = {
    "database": "concat('db', {k} % 4)",
    "table": "concat('t', {k} % 40)",
    "pos": "o_orderkey",
    "Key_name": "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'IDX_' ELSE 'idx_' END, o_orderkey % 5)",
    "Index_type": "CASE o_orderkey % 3 WHEN 0 THEN 'BITMAP' WHEN 1 THEN '' ELSE 'INVERTED' END",
    "Column_name": "CASE WHEN o_orderkey % 17 <> 3 THEN concat('c', o_totalprice_class) END",
    "Seq_in_index": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE CAST(o_orderkey % 6 AS {string}) END",
}


def _index_rows(k: str, string: str) -> str:
    columns = ", ".join(f"{e.format(k=k, string=string)} AS {n}" for n, e in _INDEX_ROWS.items())
    return f"SELECT {columns.replace(' AS table', ' AS tbl')} FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) % 7 AS o_totalprice_class FROM {{orders}})"


@query(
    "agg_18_index_list",
    f"WITH raw AS ({_index_rows('o_custkey', 'VARCHAR').format(orders='orders')}), "
    "placed AS (SELECT *, lower(Key_name) AS key, TRY_CAST(Seq_in_index AS BIGINT) AS seq, "
    "count(Column_name) OVER (PARTITION BY database, tbl, lower(Key_name) ORDER BY pos) AS nth FROM raw), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY database, tbl, key ORDER BY CASE WHEN seq > 0 THEN seq ELSE nth END, Column_name, nth) AS r "
    "FROM placed WHERE Column_name IS NOT NULL), "
    "apart AS (SELECT *, lag(Column_name) OVER (PARTITION BY database, tbl, key ORDER BY r) AS earlier FROM ranked), "
    "listed AS (SELECT database, tbl, key, string_agg(Column_name, ',' ORDER BY r) AS columns FROM apart WHERE earlier IS NULL OR earlier <> Column_name GROUP BY ALL), "
    "named AS (SELECT database, tbl, key, min_by(Key_name, pos) AS name, coalesce(min_by(Index_type, pos) FILTER (Index_type <> ''), '') AS index_type FROM placed GROUP BY ALL) "
    "SELECT database, tbl AS \"table\", name, index_type, coalesce(columns, '') AS columns FROM named LEFT JOIN listed USING (database, tbl, key)",
)
def agg_18(spark, sf):
    raw = spark.sql(_index_rows("o_custkey", "STRING").format(orders="{orders}"), orders=spark.read.parquet(f"{sf}/orders.parquet"))
    rows = inputs.index_list(raw.withColumnRenamed("tbl", "table"))
    return rows.select("database", "table", "name", "index_type", F.array_join("columns", ",").alias("columns"))


@query(
    "rule_detail_bucket_rules",
    sql(
        BAND
        + ', st AS (SELECT database, "table", any_value(k) AS k, '
        f"count(*) FILTER ({VALID}) AS valid, count(*) FILTER ({VALID} AND buckets < lower_bound) AS small, count(*) FILTER ({VALID} AND buckets > upper_bound) AS large FROM band GROUP BY 1, 2) "
        "SELECT database, \"table\", 'SA-B001' AS rule_id, CASE WHEN small >= 3 OR small / valid::DOUBLE >= 0.5 THEN 'warn' ELSE 'info' END AS severity FROM st WHERE valid > 0 AND small > 0 "
        "UNION ALL SELECT database, \"table\", 'SA-B002', CASE WHEN large >= 3 OR large / valid::DOUBLE >= 0.5 THEN 'warn' ELSE 'info' END FROM st WHERE valid > 0 AND large > 0 "
        "UNION ALL SELECT database, \"table\", 'SA-B004', 'warn' FROM st WHERE valid = 0 "
        "UNION ALL SELECT database, \"table\", 'SA-B005', CASE WHEN k % 6 = 0 THEN 'critical' ELSE 'info' END FROM st WHERE k % 6 IN (0, 4) "
        "UNION ALL SELECT database, \"table\", 'SA-B006', CASE WHEN k % 6 = 1 THEN 'critical' ELSE 'warn' END FROM st WHERE k % 6 IN (1, 2)"
    ),
)
def rule_bucket(spark, sf):
    rows = findings.one_per_row(_detail(spark, sf))
    wanted = F.col("rule_id").isin("SA-B001", "SA-B002", "SA-B004", "SA-B005", "SA-B006")
    return rows.where(wanted).select("database", "table", "rule_id", "severity")


@query(
    "rule_detail_empty_ratio",
    sql(
        f', st AS (SELECT database, "table", any_value(k) AS k, (count(*) FILTER (empty) - count(*) FILTER (empty AND {FUTURE})) / '
        f"nullif(count(*) - count(*) FILTER ({FUTURE}), 0)::DOUBLE AS ratio FROM p GROUP BY 1, 2) "
        "SELECT database, \"table\", 'SA-E001' AS rule_id, CASE WHEN ratio >= 0.6 THEN 'critical' ELSE 'warn' END AS severity, "
        f"(CASE WHEN k IN (3, 6) THEN 0.75 ELSE 0.95 END)::DOUBLE AS confidence FROM st WHERE ratio >= 0.3 "
        f"UNION ALL SELECT database, \"table\", 'SA-D004', 'warn', (CASE WHEN k IN (3, 6) THEN 0.65 ELSE 0.9 END)::DOUBLE FROM st WHERE ratio >= 0.6 AND {ON}"
    ),
)
def rule_empty(spark, sf):
    rows = findings.one_per_row(_detail(spark, sf)).where(F.col("rule_id").isin("SA-E001", "SA-D004"))
    return rows.select("database", "table", "rule_id", "severity", "confidence")


@query("rule_detail_findings")
def rule_detail(spark, sf):
    rows = findings.one_per_row(_detail(spark, sf))
    return rows.withColumn("evidence", findings.evidence_json(F.col("numbers"), F.col("details"))).drop("numbers", "details")


@query("agg_22_detail_scores")
def agg_22(spark, sf):
    return _detail(spark, sf).select("database", "table", "finding_count", "score").orderBy(*scan.item_order())


@query("flt_12_finding_split")
def flt_12(spark, sf):
    rows = findings.one_per_row(_detail(spark, sf))
    return rows.groupBy("database", "table").agg(
        F.count_if(findings.is_bucket_rule(F.col("rule_id"))).alias("bucket"),
        F.count_if(~findings.is_bucket_rule(F.col("rule_id"))).alias("other"),
    )
