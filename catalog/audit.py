"""Workload queries over the audit tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.corpus_audit import DATASET, PRELUDE, accepted_source, audit_source, audit_tables, duck_base, duck_guess, duck_strip
from catalog.registry import query
from querylens.functions import display, sqltext
from querylens.operators import dimension, filters, overview, quantiles, samples, series, share
from querylens.operators import top_sql as top
from querylens.operators.filters import ALL, QueryFilters

VISIBLE = "r.is_internal IS NOT TRUE"
FAILED = "CASE WHEN error_code IS NOT NULL AND error_code <> 0 THEN 1 WHEN state IN ('EOF','OK') THEN 0 ELSE 1 END"
SUMS = (
    "count(*) AS exec_count, CAST(coalesce(sum(cpu_time_ms), 0) AS BIGINT) AS total_cpu_ms, "
    "CAST(coalesce(sum(query_time_ms), 0) AS BIGINT) AS total_time_ms"
)
# 2024-01-05 .. 2024-01-20
START, END = 1704412800000, 1705708800000
RANGED = QueryFilters(start_ms=START, end_ms=END, exclude_internal=False)


def sql(text: str) -> str:
    return PRELUDE + text


@query(
    "agg_01_template_dictionary",
    sql("SELECT dataset_id, stripped_template_id, sql_template_stripped, table_guess FROM t"),
)
def agg_01(spark, sf):
    return audit_tables(spark, sf)[1].select(
        "dataset_id", "stripped_template_id", "sql_template_stripped", "table_guess"
    )


@query(
    "win_03_first_seen_ids",
    sql("SELECT stripped_template_id, min(record_id) AS first_id, count(*) AS n FROM r GROUP BY 1"),
)
def win_03(spark, sf):
    records, _ = audit_tables(spark, sf)
    return records.groupBy("stripped_template_id").agg(
        F.min("record_id").alias("first_id"), F.count("*").alias("n")
    )


FIGURES = (
    "SELECT count(*) AS records, CAST(coalesce(sum(cpu_time_ms),0) AS BIGINT) AS total_cpu_ms, "
    "CAST(coalesce(sum(query_time_ms),0) AS BIGINT) AS total_time_ms, "
    f"CAST(coalesce(sum({FAILED}),0) AS BIGINT) AS failed_count, min(event_time_ms) AS min_time_ms, "
    "max(event_time_ms) AS max_time_ms, quantile_disc(query_time_ms, 0.95) AS p95_time_ms, "
    "quantile_disc(query_time_ms, 0.99) AS p99_time_ms, count(DISTINCT user_name) AS distinct_users, "
    "count(DISTINCT db_name) AS distinct_dbs, count(DISTINCT client_ip) AS distinct_client_ips, "
    f"count(DISTINCT stripped_template_id) AS distinct_templates FROM r WHERE {VISIBLE}"
)


@query("agg_02_overview", sql(FIGURES))
def agg_02(spark, sf):
    return overview.key_figures(audit_tables(spark, sf)[0], dataset_id=DATASET, exact=True)


@query("agg_03_approx_quantile")
def agg_03_approx(spark, sf):
    records, _ = audit_tables(spark, sf)
    return records.groupBy("stripped_template_id").agg(
        quantiles.approx_quantile("query_time_ms", 0.95).alias("p95_time_ms")
    )


@query(
    "agg_03_exact_quantile",
    sql(
        "SELECT stripped_template_id, quantile_disc(query_time_ms, 0.5) AS p50, quantile_disc(query_time_ms, 0.95) AS p95, "
        "quantile_disc(query_time_ms, 0.99) AS p99 FROM r GROUP BY 1"
    ),
)
def agg_03_exact(spark, sf):
    return quantiles.exact_quantiles(
        audit_tables(spark, sf)[0], ["stripped_template_id"], "query_time_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    )


@query("agg_04_approx_distinct")
def agg_04_approx(spark, sf):
    return overview.key_figures(audit_tables(spark, sf)[0], ALL).select(
        "distinct_users", "distinct_dbs", "distinct_client_ips", "distinct_templates"
    )


@query(
    "agg_04_exact_distinct",
    sql(
        "SELECT db_name, count(DISTINCT user_name) AS users, count(DISTINCT stripped_template_id) AS templates "
        "FROM r GROUP BY db_name"
    ),
)
def agg_04_exact(spark, sf):
    return audit_tables(spark, sf)[0].groupBy("db_name").agg(
        F.count_distinct("user_name").alias("users"), F.count_distinct("stripped_template_id").alias("templates")
    )


@query(
    "agg_05_failures",
    sql(f"SELECT state, error_code, CAST(sum({FAILED}) AS BIGINT) AS failed, count(*) AS n FROM r GROUP BY 1, 2"),
)
def agg_05(spark, sf):
    return audit_tables(spark, sf)[0].groupBy("state", "error_code").agg(
        F.sum(filters.failed()).alias("failed"), F.count("*").alias("n")
    )


@query(
    "agg_06_top_dimensions",
    sql(
        "SELECT * FROM (SELECT dimension, name, exec_count, total_cpu_ms, total_time_ms, "
        "CAST(row_number() OVER (PARTITION BY dimension ORDER BY cpu DESC NULLS LAST, name) AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {d} AS name, {SUMS}, sum(cpu_time_ms) AS cpu FROM r "
            f"WHERE {VISIBLE} AND {d} IS NOT NULL AND {d} <> '' GROUP BY {d}"
            for d in overview.DIMENSIONS
        )
        + ")) WHERE rank <= 20"
    ),
)
def agg_06(spark, sf):
    return overview.top_dimensions(audit_tables(spark, sf)[0], dataset_id=DATASET)


TABLES = (
    "SELECT coalesce(parts[-2], '') AS db_name, parts[-1] AS table_name, exec_count, total_cpu_ms, total_time_ms FROM ("
    f"SELECT string_split(t.table_guess, '.') AS parts, {SUMS} FROM r "
    "JOIN t USING (dataset_id, stripped_template_id) "
    f"WHERE {VISIBLE} AND t.table_guess IS NOT NULL AND t.table_guess <> '' "
    "GROUP BY t.table_guess ORDER BY sum(cpu_time_ms) DESC NULLS LAST, t.table_guess LIMIT 20)"
)


@query("agg_07_top_tables", sql(TABLES))
def agg_07(spark, sf):
    return overview.top_tables(*audit_tables(spark, sf), dataset_id=DATASET)


TOP_SQL = (
    "SELECT CAST(row_number() OVER (ORDER BY cpu DESC NULLS LAST, template_id) AS INTEGER) AS rank, * EXCLUDE (cpu) FROM ("
    "SELECT stripped_template_id AS template_id, any_value(t.sql_template_stripped) AS template, "
    f"any_value(t.table_guess) AS table_guess, {SUMS}, round(coalesce(avg(query_time_ms), 0), 6) AS avg_time_ms, "
    "coalesce(max(query_time_ms), 0) AS max_time_ms, quantile_disc(query_time_ms, 0.95) AS p95_time_ms, "
    "max(peak_memory_bytes) AS max_peak_mem_bytes, sum(cpu_time_ms) AS cpu "
    "FROM r JOIN t USING (dataset_id, stripped_template_id) WHERE {where} GROUP BY 1 "
    "ORDER BY cpu DESC NULLS LAST, template_id LIMIT {n}){search}"
)


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("agg_08_top_sql", sql(TOP_SQL.format(where=VISIBLE, n=50, search="")))
def agg_08(spark, sf):
    return rounded(top.top_sql(*audit_tables(spark, sf), dataset_id=DATASET, exact=True), "avg_time_ms")


@query(
    "flt_07_template_search",
    sql(
        TOP_SQL.format(where="contains(lower(t.sql_template_stripped), 'from click')", n=5000, search="")
    ),
)
def flt_07(spark, sf):
    rows = top.top_sql(*audit_tables(spark, sf), filters=ALL, n=5000, search="  FROM Click ", exact=True)
    return rounded(rows, "avg_time_ms")


@query("q_02_top_sql_approx")
def q_02(spark, sf):
    return top.top_sql(*audit_tables(spark, sf), dataset_id=DATASET)


@query(
    "agg_09_share_totals",
    sql(f"SELECT {SUMS.replace('exec_count', 'records')} FROM r WHERE {VISIBLE}"),
)
def agg_09(spark, sf):
    return share.share_totals(audit_tables(spark, sf)[0])


def _share_sql(rank: str, n: int, others: bool = True) -> str:
    top_rows = (
        f"SELECT CAST(stripped_template_id AS VARCHAR) AS template_key, any_value(t.sql_template_stripped) AS template, {SUMS}, "
        "max(peak_memory_bytes) AS max_peak_mem_bytes, false AS is_others FROM r JOIN t USING (dataset_id, stripped_template_id) "
        f"WHERE {VISIBLE} GROUP BY stripped_template_id ORDER BY {rank} DESC NULLS LAST, stripped_template_id LIMIT {n}"
    )
    rest = (
        " UNION ALL SELECT '__others__', 'Others', greatest(0, any_value(tot.n) - sum(exec_count))::BIGINT, "
        "greatest(0, any_value(tot.cpu) - sum(total_cpu_ms))::BIGINT, greatest(0, any_value(tot.tm) - sum(total_time_ms))::BIGINT, "
        "NULL, true FROM top, tot"
        if others
        else ""
    )
    return sql(
        f", top AS ({top_rows}), tot AS (SELECT count(*) AS n, sum(cpu_time_ms)::BIGINT AS cpu, sum(query_time_ms)::BIGINT AS tm "
        f"FROM r WHERE {VISIBLE}), allrows AS (SELECT * FROM top{rest}) "
        "SELECT allrows.*, round(total_cpu_ms / tot.cpu, 9) AS cpu_share, round(total_time_ms / tot.tm, 9) AS time_share "
        "FROM allrows, tot"
    )


def _shares(df):
    return df.withColumn("cpu_share", F.round("cpu_share", 9)).withColumn("time_share", F.round("time_share", 9))


@query("agg_10_share_by_cpu", _share_sql("sum(cpu_time_ms)", 12))
def agg_10(spark, sf):
    return _shares(share.share(*audit_tables(spark, sf), dataset_id=DATASET))


@query("sort_02_share_by_time", _share_sql("sum(query_time_ms)", 5))
def sort_02(spark, sf):
    return _shares(share.share(*audit_tables(spark, sf), n=5, rank_by="total_time_ms"))


@query("flt_13_share_by_memory", _share_sql("max(peak_memory_bytes)", 7, others=False))
def flt_13(spark, sf):
    return _shares(share.share(*audit_tables(spark, sf), n=7, metric="memory"))


TEMPLATE = 2


@query(
    "agg_11_dimension_tops",
    sql(
        "SELECT * FROM (SELECT dimension, name, exec_count, total_cpu_ms, total_time_ms, "
        "CAST(row_number() OVER (PARTITION BY dimension ORDER BY cpu DESC NULLS LAST, name) AS INTEGER) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {d} AS name, {SUMS}, sum(cpu_time_ms) AS cpu FROM r "
            f"WHERE {VISIBLE} AND stripped_template_id = {TEMPLATE} AND {d} IS NOT NULL AND {d} <> '' GROUP BY {d}"
            for d in overview.DIMENSIONS
        )
        + ")) WHERE rank <= 10"
    ),
)
def agg_11(spark, sf):
    return dimension.template_detail(audit_tables(spark, sf)[0], TEMPLATE).dimensions


@query(
    "sort_04_dimension_by_count",
    sql(
        f"SELECT user_name AS name, {SUMS} FROM r WHERE {VISIBLE} AND stripped_template_id = {TEMPLATE} "
        "AND user_name IS NOT NULL AND user_name <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 80"
    ),
)
def sort_04(spark, sf):
    return dimension.dimension_top(audit_tables(spark, sf)[0], TEMPLATE, "user_name", n=80, rank_by="exec_count")


@query(
    "agg_12_time_buckets",
    sql(f"SELECT event_time_ms // 3600000 * 3600000 AS bucket_ms, {SUMS} FROM r GROUP BY 1"),
)
def agg_12(spark, sf):
    return overview.with_zero_totals(series.bucket_sums(audit_tables(spark, sf)[0], 3_600_000))


def _series_sql(width: int, where: str, low: str, high: str) -> str:
    return sql(
        f", f AS (SELECT * FROM r WHERE stripped_template_id = {TEMPLATE} AND event_time_ms IS NOT NULL AND {where}), "
        f"lim AS (SELECT {low} // {width} * {width} AS lo, ({high} + {width - 1}) // {width} * {width} AS hi FROM f), "
        f"spine AS (SELECT unnest(generate_series(lo, hi - 1, {width})) AS bucket_ms FROM lim), "
        f"agg AS (SELECT event_time_ms // {width} * {width} AS bucket_ms, {SUMS} FROM f GROUP BY 1) "
        f"SELECT CAST({width // 1000} AS INTEGER) AS bucket_seconds, bucket_ms, coalesce(exec_count, 0) AS exec_count, "
        "coalesce(total_cpu_ms, 0) AS total_cpu_ms, coalesce(total_time_ms, 0) AS total_time_ms "
        "FROM spine LEFT JOIN agg USING (bucket_ms)"
    )


@query("agg_13_template_series", _series_sql(21600000, VISIBLE.replace("r.", ""), "min(event_time_ms)", "max(event_time_ms) + 1"))
def agg_13(spark, sf):
    return series.template_series(audit_tables(spark, sf)[0], TEMPLATE, 21600).drop("bucket_start")


@query(
    "join_09_series_widened",
    # 15 days in one-minute buckets are more than the maximum asked for, 15-minute buckets are the first that fit
    _series_sql(900000, f"event_time_ms >= {START} AND event_time_ms < {END}", f"min({START})", f"min({END})"),
)
def join_09(spark, sf):
    return series.template_series(audit_tables(spark, sf)[0], TEMPLATE, 60, RANGED, max_buckets=2000).drop("bucket_start")


@query(
    "join_09_series_as_asked",
    _series_sql(60000, f"event_time_ms >= {START} AND event_time_ms < {END}", f"min({START})", f"min({END})"),
)
def join_09_as_asked(spark, sf):
    return series.template_series(audit_tables(spark, sf)[0], TEMPLATE, 60, RANGED).drop("bucket_start")


SAMPLE_COLUMNS = ", ".join(
    f"nullif({c}, '') AS {c}" if c in ("query_id", "user_name", "db_name", "client_ip", "state", "stmt_raw") else c
    for c in samples.COLUMNS
)


@query(
    "prj_01_samples",
    sql(
        f"SELECT {SAMPLE_COLUMNS} FROM r WHERE {VISIBLE} AND stripped_template_id = {TEMPLATE} "
        "ORDER BY query_time_ms DESC NULLS LAST, event_time_ms DESC NULLS LAST, record_id DESC LIMIT 50"
    ),
)
def prj_01(spark, sf):
    return samples.samples(audit_tables(spark, sf)[0], TEMPLATE, dataset_id=DATASET)


@query(
    "sort_03_samples_by_memory",
    sql(
        f"SELECT {SAMPLE_COLUMNS} FROM r WHERE stripped_template_id = {TEMPLATE} "
        "ORDER BY peak_memory_bytes DESC NULLS LAST, event_time_ms DESC NULLS LAST, record_id DESC LIMIT 9999"
    ),
)
def sort_03(spark, sf):
    return samples.samples(audit_tables(spark, sf)[0], TEMPLATE, ALL, limit=9999, order_by="peak_memory_bytes")


def _count(where: str) -> str:
    return sql(f"SELECT count(*) AS n, CAST(sum(record_id) AS BIGINT) AS ids FROM r WHERE {where}")


def _counted(df):
    return df.agg(F.count("*").alias("n"), F.sum("record_id").alias("ids"))


@query("flt_01_dataset", _count("dataset_id = 'events'"))
def flt_01(spark, sf):
    return _counted(filters.apply_filters(audit_tables(spark, sf)[0], ALL, DATASET))


@query(
    "flt_02_string_equality",
    _count("user_name = 'u7' AND db_name = 'db2' AND client_ip = '10.0.3.1' OR (state = 'EOF' AND cloud_cluster_name = 'cg1' AND db_name = 'db1')"),
)
def flt_02(spark, sf):
    records, _ = audit_tables(spark, sf)
    one = QueryFilters(exclude_internal=False, user_name=" u7 ", db_name="db2", client_ip="10.0.3.1", state="  ")
    two = QueryFilters(exclude_internal=False, state="EOF", cloud_cluster_name="cg1", db_name="db1")
    return _counted(filters.apply_filters(records, one).union(filters.apply_filters(records, two)))


@query("flt_03_exclude_internal", _count(VISIBLE))
def flt_03(spark, sf):
    return _counted(filters.apply_filters(audit_tables(spark, sf)[0]))


@query("flt_04_time_range", _count(f"event_time_ms >= {START} AND event_time_ms < {END}"))
def flt_04(spark, sf):
    return _counted(filters.apply_filters(audit_tables(spark, sf)[0], RANGED))


@query("flt_05_template", _count(f"stripped_template_id = {TEMPLATE}"))
def flt_05(spark, sf):
    return _counted(filters.apply_filters(audit_tables(spark, sf)[0], ALL, template_id=TEMPLATE))


@query("flt_06_non_blank", _count("user_name IS NOT NULL AND user_name <> '' AND db_name IS NOT NULL AND db_name <> ''"))
def flt_06(spark, sf):
    rows = audit_tables(spark, sf)[0]
    return _counted(rows.where(filters.non_blank("user_name") & filters.non_blank("db_name")))


@query(
    "flt_09_data_range",
    sql(
        "SELECT count(*) AS n, min(event_time_ms) AS start_ms, max(event_time_ms) + 1 AS end_ms FROM r "
        f"WHERE {VISIBLE}"
    ),
)
def flt_09(spark, sf):
    """The range taken from the data, fed back as a filter, loses no record."""
    records, _ = audit_tables(spark, sf)
    span = overview.data_range(overview.key_figures(records))
    low, high = span.first()
    kept = filters.apply_filters(records, QueryFilters(start_ms=low, end_ms=high))
    return kept.agg(F.count("*").alias("n")).select("n", F.lit(low).alias("start_ms"), F.lit(high).alias("end_ms"))


@query(
    "prj_02_zero_totals",
    sql(
        "SELECT record_id % 29 AS k, count(*) AS exec_count, CAST(coalesce(sum(cpu_time_ms), 0) AS BIGINT) AS total_cpu_ms, "
        "max(cpu_time_ms) AS max_cpu_ms FROM r GROUP BY 1"
    ),
)
def prj_02(spark, sf):
    rows = audit_tables(spark, sf)[0].groupBy((F.col("record_id") % 29).alias("k"))
    sums = rows.agg(*overview.workload_sums(), F.max("cpu_time_ms").alias("max_cpu_ms"))
    return overview.with_zero_totals(sums).drop("total_time_ms")


@query(
    "prj_03_workload_rates",
    sql(
        f", f AS ({FIGURES}) SELECT max_time_ms - min_time_ms AS duration_ms, "
        "round(records / ((max_time_ms - min_time_ms) / 1000.0), 9) AS qps, round(failed_count / records, 9) AS failure_ratio, "
        "round(total_time_ms / (max_time_ms - min_time_ms), 9) AS avg_concurrency, "
        "round(total_cpu_ms / (max_time_ms - min_time_ms), 9) AS avg_cpu_cores FROM f"
    ),
)
def prj_03(spark, sf):
    rates = overview.workload_rates(overview.key_figures(audit_tables(spark, sf)[0]))
    return rates.select(
        "duration_ms",
        *[F.round(c, 9).alias(c) for c in ("qps", "failure_ratio", "avg_concurrency", "avg_cpu_cores")],
    )


@query(
    "prj_04_dimension_rates",
    sql(
        f", f AS ({FIGURES}) SELECT name, exec_count, top.total_cpu_ms, "
        "round(exec_count / ((max_time_ms - min_time_ms) / 1000.0), 9) AS qps, round(top.total_cpu_ms / f.total_cpu_ms, 9) AS cpu_share "
        f"FROM (SELECT db_name AS name, {SUMS} FROM r WHERE {VISIBLE} AND db_name IS NOT NULL AND db_name <> '' GROUP BY 1 "
        "ORDER BY sum(cpu_time_ms) DESC NULLS LAST, 1 LIMIT 20) top, f"
    ),
)
def prj_04(spark, sf):
    records, _ = audit_tables(spark, sf)
    rows = overview.dimension_rates(overview.top_dimension(records, "db_name"), overview.key_figures(records))
    return rows.select("name", "exec_count", "total_cpu_ms", F.round("qps", 9).alias("qps"), F.round("cpu_share", 9).alias("cpu_share"))


@query(
    "sort_09_nulls_last",
    sql(
        "SELECT record_id, CAST(row_number() OVER (PARTITION BY db_name ORDER BY peak_memory_bytes ASC NULLS LAST, record_id) AS INTEGER) AS up, "
        "CAST(row_number() OVER (PARTITION BY db_name ORDER BY peak_memory_bytes DESC NULLS LAST, record_id) AS INTEGER) AS down FROM r "
        "QUALIFY up <= 5 OR down <= 5"
    ),
)
def sort_09(spark, sf):
    records, _ = audit_tables(spark, sf)
    by_db = Window.partitionBy("db_name")
    memory = F.col("peak_memory_bytes")
    return (
        records.select("record_id", "db_name", "peak_memory_bytes")
        .withColumn("up", F.row_number().over(by_db.orderBy(filters.nulls_last(memory), "record_id")))
        .withColumn("down", F.row_number().over(by_db.orderBy(filters.nulls_last(memory, True), "record_id")))
        .where((F.col("up") <= 5) | (F.col("down") <= 5))
        .select("record_id", "up", "down")
    )


@query("str_12_normalize_statement", sql("SELECT record_id, base FROM based WHERE base IS NOT NULL"))
def str_12(spark, sf):
    rows = audit_source(spark, sf).where(F.col("stmt_raw").isNotNull())
    return rows.select("record_id", sqltext.normalize_statement(F.col("stmt_raw")).alias("base"))


@query(
    "str_13_strip_rules",
    sql(
        "SELECT template, CAST(applied AS VARCHAR) AS applied, count(*) AS n FROM (SELECT template, "
        r"concat_ws(',', CASE WHEN regexp_matches(base, '\s+and\s+is_deleted\s*=\s*\?', 'i') THEN 'strip_soft_delete_flag' END, "
        r"CASE WHEN regexp_matches(base, '\s+and\s+tenant_id\s*=\s*\?', 'i') THEN 'strip_tenant_id' END) AS applied FROM acc) GROUP BY 1, 2"
    ),
)
def str_13(spark, sf):
    base = sqltext.normalize_statement(F.col("stmt_raw"))
    rows = accepted_source(spark, sf).select("template", F.array_join(sqltext.applied_rules(base), ",").alias("applied"))
    return rows.groupBy("template", "applied").agg(F.count("*").alias("n"))


@query("str_14_table_guess", sql(f"SELECT record_id, {duck_guess('base', 'db_name')} AS table_guess FROM acc"))
def str_14(spark, sf):
    guess = sqltext.table_guess(F.col("stmt_raw"), F.col("db_name"))
    return accepted_source(spark, sf).select("record_id", guess.alias("table_guess"))


@query(
    "str_21_sql_label",
    sql(
        r"SELECT record_id, CASE WHEN length(s) <= 60 THEN s ELSE left(s, 28) || '...' || right(s, 29) END AS label "
        r"FROM (SELECT record_id, trim(regexp_replace(stmt_raw, '\s+', ' ', 'g')) AS s FROM r)"
    ),
)
def str_21(spark, sf):
    return audit_tables(spark, sf)[0].select("record_id", display.sql_label(F.col("stmt_raw"), 60).alias("label"))


def _fixed_sql(value: str, digits: int) -> str:
    """printf rounds exact ties to even; the formats round them up."""
    scaled = f"({value}) * {2 ** (digits + 1)}"
    tie = f"{scaled} = floor({scaled}) AND floor({scaled})::BIGINT % 2 = 1"
    return f"printf('%.{digits}f', ({value}) + CASE WHEN {tie} THEN {10.0 ** -(digits + 1)} ELSE 0.0 END)"


@query(
    "str_22_human_formats",
    sql(
        "SELECT record_id, CASE WHEN ms < 1000 THEN printf('%.0f ms', ms) "
        f"WHEN ms < 60000 THEN {_fixed_sql('ms / 1000', 2)} || ' s' "
        f"WHEN ms < 3600000 THEN {_fixed_sql('ms / 1000 / 60', 2)} || ' min' ELSE {_fixed_sql('ms / 1000 / 3600', 2)} || ' h' END AS duration, "
        f"CASE WHEN b IS NULL THEN '-' WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN {_fixed_sql('b / 1024', 1)} || ' KB' "
        f"WHEN b < 1073741824 THEN {_fixed_sql('b / 1048576', 1)} || ' MB' ELSE {_fixed_sql('b / 1073741824', 1)} || ' GB' END AS memory, "
        "printf('%.2f%%', (record_id % 400 / 4.0)::DOUBLE) AS share "
        "FROM (SELECT record_id, (query_time_ms * 250)::DOUBLE AS ms, peak_memory_bytes::DOUBLE AS b FROM r)"
    ),
)
def str_22(spark, sf):
    return audit_tables(spark, sf)[0].select(
        "record_id",
        display.duration_label(F.col("query_time_ms") * 250).alias("duration"),
        display.bytes_label(F.col("peak_memory_bytes")).alias("memory"),
        display.percent_label(F.col("record_id") % 400 / 400.0).alias("share"),
    )
