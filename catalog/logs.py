"""Ingest queries: the rendered log files read back must give the records they were made from."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.audit import sql
from catalog.corpus_audit import DATASET, audit_source, audit_tables
from catalog.corpus_logs import corpus, ingested
from catalog.registry import query, stored, table
from querylens.functions import coerce, encode, sqltext
from querylens.ordering import Buckets, carry_last, position
from querylens.schemas import PARSED_FIELDS
from querylens.session import scratch_dir, stage
from querylens.sources import detect, fe_log, lookback, mysqldump, outfile, sinks
from querylens.sources.ingest import ingest
from querylens.sources.lines import read_lines


def _fields(internal: str, stmt: str) -> str:
    special = {"user_name": "nullif(user_name, '') AS user_name", "is_internal": f"{internal} AS is_internal", "stmt_raw": f"{stmt} AS stmt_raw"}
    return ", ".join(special.get(c, c) for c in PARSED_FIELDS)


LF_STMT = "replace(stmt_raw, chr(13) || chr(10), chr(10))"


def _entries(spark, sf) -> DataFrame:
    return stored(spark, sf, "fe-entries", lambda: stage(fe_log.read_fe_log(spark, corpus(spark, sf, "fe")), "fe"))


def _parts(spark, sf) -> DataFrame:
    return stored(spark, sf, "dump-parts", lambda: mysqldump.read_parts(spark, corpus(spark, sf, "dump")))


def _folder(column: str = "file"):
    return F.element_at(F.split(column, "/"), -2)


@query(
    "src_01_detect_formats",
    "SELECT * FROM (VALUES ('fe', 'feAuditLog', NULL), ('dump', 'auditLogMysqlDump', NULL), ('csv', 'auditLogOutfileCsv', ','), "
    "('tsv', 'auditLogOutfileCsv', chr(9)), ('header', 'auditLogOutfileCsv', chr(9))) v(kind, format, delimiter)",
)
def src_01(spark, sf):
    paths = [corpus(spark, sf, kind) for kind in ("fe", "dump", "csv", "tsv", "header")]
    found = detect.detect_formats(read_lines(spark, paths))
    return found.select(_folder().alias("kind"), "format", "delimiter").distinct()


ENTRY_TAGS = "CASE WHEN record_id % 13 <> 0 AND record_id % 5 = 0 THEN 2 ELSE 1 END"


@query(
    "src_02_lines",
    sql(
        f"SELECT CAST(sum({ENTRY_TAGS} * (1 + coalesce(length(stmt_raw) - length(replace(stmt_raw, chr(10), '')), 0))) AS BIGINT) AS n_lines, "
        f"CAST(sum({ENTRY_TAGS} * coalesce(length(stmt_raw) - length(replace(stmt_raw, chr(13), '')), 0)) AS BIGINT) AS n_cr FROM src"
    ),
)
def src_02(spark, sf):
    lines = read_lines(spark, corpus(spark, sf, "fe"))
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(F.endswith("value", F.lit("\r"))).alias("n_cr"))


@query(
    "src_03_record_blocks",
    sql(
        f"SELECT query_id, CAST({ENTRY_TAGS} AS BIGINT) AS n_blocks, "
        f"CAST({ENTRY_TAGS} * (1 + coalesce(length(stmt_raw) - length(replace(stmt_raw, chr(10), '')), 0)) AS BIGINT) AS n_lines FROM src"
    ),
)
def src_03(spark, sf):
    blocks = fe_log.record_blocks(read_lines(spark, corpus(spark, sf, "fe")))
    by_id = blocks.select(
        F.regexp_extract("text", r"\|QueryId=([^|]*)", 1).alias("query_id"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n"),
    )
    return by_id.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.sum("n").alias("n_lines"))


@query("src_04_fe_log_records", sql(f"SELECT {_fields('is_internal', LF_STMT)}, template FROM acc"))
def src_04(spark, sf):
    entries = fe_log.drop_slow_twins(_entries(spark, sf))
    return entries.where(F.col("template") != "").select(*PARSED_FIELDS, "template")


def _exported(where: str) -> str:
    return sql(f"SELECT {_fields('CAST(NULL AS BOOLEAN)', 'stmt_raw')}, coalesce(template, '') AS template FROM (SELECT src.*, acc.template FROM src LEFT JOIN acc USING (record_id)) WHERE {where}")


def _export_rows(spark, sf, kind: str, delimiter: str) -> DataFrame:
    rows = outfile.read_outfile(spark, corpus(spark, sf, kind), delimiter)
    return rows.where("valid").select(*PARSED_FIELDS, F.coalesce("template", F.lit("")).alias("template"))


@query("src_05_outfile_tsv_positional", _exported("true"))
def src_05(spark, sf):
    return _export_rows(spark, sf, "tsv", "\t")


@query("str_03_outfile_csv_quoted", _exported("record_id % 100 <> 7"))
def str_03(spark, sf):
    return _export_rows(spark, sf, "csv", ",")


@query("src_07_outfile_tsv_header", _exported("true"))
def src_07(spark, sf):
    return _export_rows(spark, sf, "header", "\t")


@query("src_06_line_delimiter", sql("SELECT kind, delimiter, count(*) AS n FROM (SELECT unnest(['csv', 'tsv']) AS kind, record_id FROM src) s JOIN (VALUES ('csv', ','), ('tsv', chr(9))) v(k, delimiter) ON v.k = s.kind WHERE NOT (kind = 'csv' AND record_id % 100 = 7) GROUP BY 1, 2"))
def src_06(spark, sf):
    lines = read_lines(spark, [corpus(spark, sf, "csv"), corpus(spark, sf, "tsv")])
    found = lines.select(_folder().alias("kind"), outfile.line_delimiter(F.col("value")).alias("delimiter"))
    return found.where(F.col("delimiter").isNotNull()).groupBy("kind", "delimiter").agg(F.count("*").alias("n"))


@query("src_08_row_width", sql("SELECT record_id % 100 <> 7 AS valid, count(*) AS n FROM src GROUP BY 1"))
def src_08(spark, sf):
    rows = outfile.read_outfile(spark, corpus(spark, sf, "csv"), ",")
    return rows.groupBy("valid").agg(F.count("*").alias("n"))


GROUPS = "(SELECT DISTINCT record_id // 50 AS g FROM src)"


@query(
    "src_09_dump_statements",
    sql(f"SELECT CASE WHEN g % 3 = 0 THEN 2 ELSE 1 END AS k, count(*) AS n_groups, CAST(count(*) * any_value(CASE WHEN g % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM {GROUPS} GROUP BY 1"),
)
def src_09(spark, sf):
    """Statements that follow another one on their line come in pairs."""
    read = _parts(spark, sf)
    is_set = F.startswith(coerce.trim(F.col("text")), F.lit("SET NAMES"))
    sets = read.agg(F.count_if(is_set).alias("s")).crossJoin(mysqldump.statement_count(read).agg(F.sum("statements_scanned").alias("n")))
    pairs = sets.select(F.lit(2).alias("k"), F.col("s").alias("n_groups"), (F.col("s") * 2).alias("n"))
    single = sets.select(
        F.lit(1).alias("k"), (F.col("n") - 2 * F.col("s")).alias("n_groups"), (F.col("n") - 2 * F.col("s")).alias("n")
    )
    return pairs.union(single)


@query(
    "src_10_audit_insert_matcher",
    sql(f"SELECT count(*) AS n FROM {GROUPS}"),
)
def src_10(spark, sf):
    return mysqldump.parse_inserts(_parts(spark, sf)).agg(F.count("*").alias("n"))


@query(
    "src_11_dump_tuples",
    sql("SELECT g, CAST(count(*) + sum(CASE WHEN record_id % 71 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_tuples FROM (SELECT record_id // 50 AS g, record_id FROM src) GROUP BY g"),
)
def src_11(spark, sf):
    rows = mysqldump.tuple_records(_parts(spark, sf))
    group = F.floor(F.max((F.substr(F.col("query_id"), F.lit(3))).cast("bigint")) / 50)
    return rows.groupBy("file", "statement_seq").agg(group.alias("g"), F.count("*").alias("n_tuples")).select("g", "n_tuples")


@query(
    "src_11_dump_of_few_inserts",
    sql(f"SELECT {_fields('is_internal', 'stmt_raw')}, coalesce(template, '') AS template FROM (SELECT src.*, acc.template FROM src LEFT JOIN acc USING (record_id))"),
)
def src_11_few(spark, sf):
    """The whole table in a few statements, each as long as a file."""
    read = stored(spark, sf, "dump-single-parts", lambda: mysqldump.read_parts(spark, corpus(spark, sf, "dump-single")))
    rows = mysqldump.tuple_records(read)
    return rows.where(~F.col("is_noise")).select(*PARSED_FIELDS, F.coalesce("template", F.lit("")).alias("template"))


@query(
    "src_13_dump_records",
    sql(f"SELECT {_fields('CASE WHEN record_id // 50 % 2 = 0 THEN is_internal END', 'stmt_raw')}, coalesce(template, '') AS template FROM (SELECT src.*, acc.template FROM src LEFT JOIN acc USING (record_id))"),
)
def src_13(spark, sf):
    rows = mysqldump.tuple_records(_parts(spark, sf))
    return rows.where(~F.col("is_noise")).select(*PARSED_FIELDS, F.coalesce("template", F.lit("")).alias("template"))


@query("src_14_known_noise", sql("SELECT count(*) FILTER (record_id % 71 = 0) AS noise, count(*) AS kept FROM src"))
def src_14(spark, sf):
    rows = mysqldump.tuple_records(_parts(spark, sf))
    return rows.agg(F.count_if("is_noise").alias("noise"), F.count_if(~F.col("is_noise")).alias("kept"))


@query(
    "src_15_malformed_statements",
    sql(f"SELECT 'tuple cannot be read' AS reason, count(*) AS n FROM {GROUPS} WHERE g % 10 = 9 HAVING count(*) > 0"),
)
def src_15(spark, sf):
    bad = mysqldump.rejects(mysqldump.parse_inserts(_parts(spark, sf)))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "src_16_slow_twins",
    # a twin stays when its query entry could not be stored; neither can the twin
    sql(
        "SELECT record_id % 13 = 0 AS slow_only, count(*) AS n FROM src "
        "LEFT JOIN (SELECT unnest([1, 2]) AS copy) c ON (copy = 1 OR (record_id % 13 <> 0 AND record_id % 5 = 0 AND record_id % 97 = 0)) GROUP BY 1"
    ),
)
def src_16(spark, sf):
    kept = fe_log.drop_slow_twins(_entries(spark, sf))
    number = F.substr(F.col("block_query_id"), F.lit(3)).cast("bigint")
    return kept.groupBy((number % 13 == 0).alias("slow_only")).agg(F.count("*").alias("n"))


@query(
    "src_17_record_ids",
    sql("SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, query_id, stripped_template_id FROM r"),
)
def src_17(spark, sf):
    return ingested(spark, sf, "fe").records.select("record_id", "query_id", "stripped_template_id")


@query(
    "src_17_packed_log",
    sql("SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, query_id, nullif(user_name, '') AS user_name, query_time_ms, replace(stmt_raw, chr(13) || chr(10), chr(10)) AS stmt_raw FROM r"),
)
def src_17_packed(spark, sf):
    """A compressed log cannot be split; runs of its lines give the same records, texts and ids."""
    return ingested(spark, sf, "fe-packed").records.select("record_id", "query_id", "user_name", "query_time_ms", "stmt_raw")


@query(
    "src_18_statement_cut",
    "SELECT doc_id, CASE WHEN length(text) > 4096 THEN left(text, 4096) || ' ...[truncated]' ELSE text END AS shown FROM documents",
)
def src_18(spark, sf):
    """The shortened form that lists show."""
    from querylens.operators.dictionary import displayed_statement

    return table(spark, sf, "documents").select("doc_id", displayed_statement(F.col("text")).alias("shown"))


@query("src_18_statement_stored", sql("SELECT row_number() OVER (ORDER BY record_id) - 1 AS record_id, replace(stmt_raw, chr(13) || chr(10), chr(10)) AS stmt_raw FROM r"))
def src_18_stored(spark, sf):
    """Stored statements are whole, whatever their length; a log line does not keep the return at its end."""
    return ingested(spark, sf, "fe").records.select("record_id", "stmt_raw")


@query(
    "src_19_dataset_replace",
    sql(
        "SELECT 'events' AS dataset_id, count(*) AS n, count(*) FILTER (db_name = 'db1') AS db1 FROM r UNION ALL "
        "SELECT 'copy', count(*), count(*) FROM r WHERE db_name = 'db1'"
    ),
)
def src_19(spark, sf):
    def build() -> str:
        records, _ = audit_tables(spark, sf)
        path = scratch_dir(spark, "replace")
        sinks.write_records(records, path)
        sinks.write_records(records.withColumn("dataset_id", F.lit("copy")), path)
        sinks.write_records(records.where("db_name = 'db1'").withColumn("dataset_id", F.lit("copy")), path)
        return path

    rows = spark.read.parquet(stored(spark, sf, "replace", build))
    return rows.groupBy("dataset_id").agg(F.count("*").alias("n"), F.count_if(F.col("db_name") == "db1").alias("db1"))


@query(
    "src_20_fact_table",
    sql(
        f"SELECT 'events' AS dataset_id, row_number() OVER (ORDER BY record_id) - 1 AS record_id, {_fields('is_internal', LF_STMT)}, stripped_template_id FROM r"
    ),
)
def src_20(spark, sf):
    """Whole path: server log files to the stored fact table."""
    return ingested(spark, sf, "fe").records


@query("src_21_template_insert_or_ignore", sql("SELECT stripped_template_id, sql_template_stripped, table_guess FROM t"))
def src_21(spark, sf):
    def build() -> str:
        _, templates = audit_tables(spark, sf)
        path = scratch_dir(spark, "dims")
        sinks.write_templates(templates.where("stripped_template_id % 2 = 0"), path)
        sinks.append_templates(templates.select("stripped_template_id", "sql_template_stripped", "table_guess", "dataset_id"), path)
        return path

    rows = spark.read.parquet(stored(spark, sf, "dims", build))
    return rows.select("stripped_template_id", "sql_template_stripped", "table_guess")


TWINS_OF_BAD = "count(*) FILTER (record_id % 97 = 0 AND record_id % 13 <> 0 AND record_id % 5 = 0)"
BAD = "count(*) FILTER (stmt_raw IS NULL)"
REPORT = (
    "SELECT 'fe' AS kind, 'feAuditLog' AS format, {n} + {twins} AS parsed, {n} - {bad} AS inserted, {bad} + {twins} AS bad, 0 AS filtered, 0 AS statements, 0 AS matched, 0 AS tuples, 0 AS bad_statements FROM src "
    "UNION ALL SELECT 'header', 'auditLogOutfileCsv', {n}, {n} - {bad}, {bad}, 0, 0, 0, 0, 0 FROM src "
    "UNION ALL SELECT 'csv', 'auditLogOutfileCsv', {n}, {n} - count(*) FILTER (stmt_raw IS NULL OR record_id % 100 = 7), count(*) FILTER (stmt_raw IS NULL OR record_id % 100 = 7), 0, 0, 0, 0, 0 FROM src "
    "UNION ALL SELECT 'dump', 'auditLogMysqlDump', {n} + {noise}, {n} - {bad}, {bad}, {noise}, "
    "count(DISTINCT record_id // 50) + count(DISTINCT record_id // 50) FILTER (record_id // 50 % 3 = 0), count(DISTINCT record_id // 50), {n} + {noise}, "
    "count(DISTINCT record_id // 50) FILTER (record_id // 50 % 10 = 9) FROM src"
).format(n="count(*)", twins=TWINS_OF_BAD, bad=BAD, noise="count(*) FILTER (record_id % 71 = 0)")


@query(
    "src_22_ingest_report",
    sql(
        "SELECT kind, format, CAST(parsed AS BIGINT) AS parsed, CAST(inserted AS BIGINT) AS inserted, CAST(bad AS BIGINT) AS bad, "
        "CAST(filtered AS BIGINT) AS filtered, CAST(statements AS BIGINT) AS statements, CAST(matched AS BIGINT) AS matched, "
        f"CAST(tuples AS BIGINT) AS tuples, CAST(bad_statements AS BIGINT) AS bad_statements FROM ({REPORT})"
    ),
)
def src_22(spark, sf):
    total = None
    for kind in ("fe", "header", "csv", "dump"):
        report = ingested(spark, sf, kind).report.groupBy(_folder().alias("kind"), F.col("format_detected").alias("format")).agg(
            F.sum("records_parsed").alias("parsed"),
            F.sum("records_inserted").alias("inserted"),
            F.sum("bad_records").alias("bad"),
            F.sum("filtered_records").alias("filtered"),
            F.sum("statements_scanned").alias("statements"),
            F.sum("insert_statements_matched").alias("matched"),
            F.sum("tuples_parsed").alias("tuples"),
            F.sum("bad_statements").alias("bad_statements"),
        )
        total = report if total is None else total.unionByName(report)
    return total


#: The first ignores case; the second does not, and the statements write AND; the last keeps a group.
RULES = (
    sqltext.DEFAULT_RULES[0],
    sqltext.StrippingRule("strip_lower_tenant_id", r"\s+and\s+tenant_id\s*=\s*\?", flags=""),
    sqltext.StrippingRule("strip_limit", r"\s+limit\s+\?", flags=""),
    sqltext.StrippingRule("plain_facts", r"from\s+([a-z]+)_facts", "from $1", flags=""),
)
_RULED = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '\s+and\s+is_deleted\s*=\s*\?', '', 'gi'), "
    r"'\s+and\s+tenant_id\s*=\s*\?', '', 'g'), '\s+limit\s+\?', '', 'g'), 'from\s+([a-z]+)_facts', 'from \1', 'g')"
)


@query(
    "str_13_rules_through_ingest",
    sql(
        f", d AS (SELECT trim({_RULED}) AS template, record_id FROM acc) "
        "SELECT kind, template, min(record_id) AS first_id, count(*) AS n FROM d, (VALUES ('fe'), ('csv'), ('dump')) v(kind) "
        "WHERE NOT (kind = 'csv' AND record_id % 100 = 7) GROUP BY 1, 2"  # these lines of the export are too short
    ),
)
def str_13_rules(spark, sf):
    total = None
    for kind in ("fe", "csv", "dump"):
        done = stored(spark, sf, f"ruled-{kind}", lambda: ingest(spark, corpus(spark, sf, kind), dataset_id="events", rules=RULES))
        number = F.substr(F.col("query_id"), F.lit(3)).cast("bigint")
        sums = done.records.groupBy("stripped_template_id").agg(F.min(number).alias("first_id"), F.count("*").alias("n"))
        rows = sums.join(done.templates, "stripped_template_id").select(F.lit(kind).alias("kind"), F.col("sql_template_stripped").alias("template"), "first_id", "n")
        total = rows if total is None else total.unionByName(rows)
    return total


@query(
    "q_08_ingest_dump_templates",
    sql(
        ", d AS (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS rid FROM acc) "
        "SELECT CAST(row_number() OVER (ORDER BY f.rid) AS INTEGER) AS stripped_template_id, f.template AS sql_template_stripped, t.table_guess "
        "FROM (SELECT template, min(rid) AS rid FROM d GROUP BY 1) f JOIN t ON t.sql_template_stripped = f.template"
    ),
)
def q_08(spark, sf):
    return ingested(spark, sf, "dump").templates.drop("dataset_id")


@query(
    "src_23_lookback",
    "SELECT event_id, ts, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'",
)
def src_23(spark, sf):
    """Every row of the look-back."""
    rows = table(spark, sf, "events")
    return lookback.lookback(rows, datetime(2024, 1, 20), 86_400, time_column="ts").select("event_id", "ts", "user_id", "event_type")


@query(
    "src_23_newest",
    "SELECT event_id, ts, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2023-12-01 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 200",
)
def src_23_newest(spark, sf):
    """A cut that the caller asks for is decided by a key; 50 days are no longer refused."""
    rows = table(spark, sf, "events")
    return lookback.lookback(rows, datetime(2024, 1, 20), 50 * 86_400, 200, "ts", key=["event_id"]).select("event_id", "ts", "user_id", "event_type")


@query("src_24_tsv_sink", sql("SELECT query_id, nullif(user_name, '') AS user_name, stmt_raw, error_message FROM src"))
def src_24(spark, sf):
    """Written with escapes and header, read back as an export."""
    rows = outfile.read_outfile(spark, corpus(spark, sf, "header"), "\t")
    return rows.select("query_id", "user_name", "stmt_raw", "error_message")


@query(
    "str_20_tsv_escape",
    r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS escaped FROM documents",
)
def str_20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", encode.tsv_field(F.col("text")).alias("escaped"))


@query("str_10_export_round_trip", "SELECT doc_id, nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') AS text FROM documents")
def str_10(spark, sf):
    """Every text, written as a field and read back; outer white space goes, and what is empty then is NULL."""
    return table(spark, sf, "documents").select("doc_id", encode.export_text(encode.tsv_field(F.col("text"))).alias("text"))


@query("str_11_dump_string_round_trip", "SELECT doc_id, text FROM documents")
def str_11(spark, sf):
    text = F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (("'", "''"), ("\n", "\\n"), ("\t", "\\t"), ('"', '\\"')):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return table(spark, sf, "documents").select("doc_id", encode.decode_dump_string(text).alias("text"))


@query(
    "str_08_event_time",
    "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events",
)
def str_08(spark, sf):
    stamp = F.col("ts").cast("timestamp")
    plus = stamp + F.expr("INTERVAL '5:30' HOUR TO MINUTE")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss,SSS"))
        .when(F.col("event_id") % 4 == 1, F.concat(F.date_format(stamp, "yyyy-MM-dd  HH:mm:ss.SSSSSS"), F.lit("Z ")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.date_format(plus, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+05:30")))
        .otherwise(F.concat(F.lit(" "), F.date_format(plus, "yyyy-MM-dd HH:mm:ss.SSSSS"), F.lit("+0530")))
    )
    return table(spark, sf, "events").select("event_id", coerce.event_time_ms(text).alias("ms"))


@query(
    "str_05_prefix_int",
    "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN -event_id ELSE event_id END AS n FROM events",
)
def str_05(spark, sf):
    number = F.col("event_id").cast("string")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), number, F.lit("ms")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("-"), number, F.lit(".9")))
        .otherwise(F.concat(F.lit("n"), number))
    )
    return table(spark, sf, "events").select("event_id", coerce.prefix_int(text).alias("n"))


@query(
    "str_06_loose_bool",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL ELSE false END AS b FROM events",
)
def str_06(spark, sf):
    words = F.array(*[F.lit(w) for w in (" YES ", "False", "1", "maybe", "n")])
    word = F.get(words, (F.col("event_id") % 5).cast("int"))
    return table(spark, sf, "events").select("event_id", coerce.loose_bool(word).alias("b"))


@query("str_07_client_address", sql("SELECT record_id, client_ip FROM src"))
def str_07(spark, sf):
    address = F.concat(F.lit(" "), F.col("client_ip"), F.lit(":"), F.col("record_id").cast("string"))
    return audit_source(spark, sf).select("record_id", coerce.client_address(address).alias("client_ip"))


@query(
    "win_02_carry_last",
    "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error FROM events",
)
def win_02(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("b", F.shiftright("event_id", 8))
    value = F.when(F.col("event_type") == "error", F.col("event_id"))
    carried = carry_last(rows, Buckets(("user_id",), ("b",), ("event_id",)), value, "last_error")
    return carried.select("event_id", "last_error")


@query(
    "win_01_positions",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events",
)
def win_01(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id").withColumn("b", F.shiftright("event_id", 8))
    return position(rows, Buckets(("user_id",), ("b",), ("event_id",)), "pos").select("event_id", "pos")


@query("col_01_first_json_string", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE NULL END AS t FROM events")
def col_01(spark, sf):
    from querylens.functions.sqltext import first_json_string

    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "x"]')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('[7, " ", " '), "event_type", F.lit(' "]')))
        .when(F.col("event_id") % 4 == 2, F.col("props"))
        .otherwise(F.lit('["broken'))
    )
    return table(spark, sf, "events").select("event_id", first_json_string(text).alias("t"))
