"""Audit records derived from ``events``, in Spark and as a DuckDB prelude.

The column texts below are plain SQL that both engines read the same way, so that a query and its
counterpart start from identical records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import stored, table
from querylens.functions.sqltext import has_template, template_of
from querylens.operators.dictionary import build_dictionary, encode_records
from querylens.schemas import PARSED_FIELDS
from querylens.session import scratch_dir, stage
from querylens.sources.sinks import write_records, write_templates

DATASET = "events"

STATEMENT = """CASE
WHEN event_id % 97 = 0 THEN NULL
WHEN event_id % 5 = 0 THEN concat('select  a, count(*) from ', event_type, '_facts where user_id = ', CAST(user_id AS STRING),
  ' and kind in (', CAST(event_id % 7 AS STRING), ', ', CAST(event_id % 11 AS STRING), ') and note = ', chr(39), 'it', chr(39), chr(39), 's ',
  event_type, chr(39), ' and is_deleted = 0')
WHEN event_id % 5 = 1 THEN concat('with recent as (select * from ', chr(96), 'db', CAST(user_id % 5 AS STRING), chr(96), ' . ', chr(96), event_type, chr(96),
  ') select * from recent r where id not  in (1, f(2), ', CAST(event_id AS STRING), ') AND tenant_id = 7')
WHEN event_id % 5 = 2 THEN concat('insert into ', event_type, ' values (', CAST(event_id AS STRING), ', ', CAST(CAST(floor(value) AS BIGINT) AS STRING), '.25)')
WHEN event_id % 5 = 3 THEN concat('select *', chr(10), chr(9), 'from ', event_type, chr(13), chr(10), 'where ts >= ', chr(39), '2024-01-01; x', chr(39), ' limit ', CAST(user_id AS STRING))
ELSE concat('select ', chr(39), 'a', chr(92), 'b', chr(39), ', -', CAST(user_id AS STRING), ', t1.c1 from stats.', event_type, ' t1')
END"""

_COLUMNS = {
    "record_id": "event_id",
    "event_time_ms": "{epoch_ms}",
    "is_internal": "CASE WHEN event_id % 10 = 0 THEN true WHEN event_id % 10 = 1 THEN NULL ELSE false END",
    "query_id": "concat('q-', CAST(event_id AS STRING))",
    "user_name": "CASE WHEN event_id % 37 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END",
    "client_ip": "concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(event_id % 16 AS STRING))",
    "fe_ip": "concat('10.1.0.', CAST(event_id % 3 AS STRING))",
    "db_name": "CASE WHEN event_id % 41 = 0 THEN NULL ELSE concat('db', CAST(user_id % 5 AS STRING)) END",
    "state": "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_type = 'error' THEN 'ERR' WHEN event_id % 4 = 0 THEN 'OK' ELSE 'EOF' END",
    "error_code": "CAST(CASE WHEN event_type = 'error' THEN 1105 WHEN event_id % 6 = 0 THEN NULL ELSE 0 END AS INTEGER)",
    "error_message": "CASE WHEN event_type = 'error' THEN 'bad\tthing' ELSE NULL END",
    "query_time_ms": "CAST(floor(value * 10) AS BIGINT)",
    "cpu_time_ms": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(floor(value * 3) AS BIGINT) END",
    "scan_bytes": "event_id * 1024",
    "scan_rows": "event_id % 1000",
    "return_rows": "event_id % 100",
    "peak_memory_bytes": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 4096 END",
    "workload_group": "concat('wg', CAST(user_id % 3 AS STRING))",
    "cloud_cluster_name": "concat('cg', CAST(event_id % 2 AS STRING))",
    "stmt_raw": STATEMENT,
    "event_type": "event_type",
}


def audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their statement text, before templates are numbered."""
    columns = [f"{sql} AS {name}" for name, sql in _COLUMNS.items()]
    epoch = "unix_millis(CAST(ts AS TIMESTAMP))"
    return table(spark, sf_dir, "events").selectExpr(*[c.replace("{epoch_ms}", epoch) for c in columns])


def accepted_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a template, each template worked out once."""

    def build() -> DataFrame:
        rows = audit_source(spark, sf_dir).withColumn("template", template_of(F.col("stmt_raw")))
        return stage(rows, "templated")

    rows = stored(spark, sf_dir, "templated", build)
    return rows.where(has_template(F.col("template")))


def audit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fact and dimension table as ingest stores them, written once per application."""

    def build() -> str:
        accepted = accepted_source(spark, sf_dir)
        dictionary = build_dictionary(accepted, DATASET)
        root = scratch_dir(spark, "audit")
        write_templates(dictionary.drop("template_key"), f"{root}/templates")
        write_records(encode_records(accepted, dictionary, DATASET, PARSED_FIELDS), f"{root}/records")
        return root

    root = stored(spark, sf_dir, "audit", build)
    return spark.read.parquet(f"{root}/records"), spark.read.parquet(f"{root}/templates")


# The normalisation rules of templates in the other dialect.
_NAME = r"(?:`[^`]+`|[a-zA-Z0-9_$]+)"
_SOURCE_SELECT = ", ".join(f"{sql} AS {name}" for name, sql in _COLUMNS.items()).replace("{epoch_ms}", "(epoch_us(ts) // 1000)")


def duck_base(stmt: str) -> str:
    out = rf"trim(regexp_replace({stmt}, '\s+', ' ', 'g'))"
    out = rf"regexp_replace({out}, '\bNOT\s+IN\s*\((?:[^()]|\([^()]*\))*\)', 'NOT IN (?)', 'gi')"
    out = rf"regexp_replace({out}, '\bIN\s*\((?:[^()]|\([^()]*\))*\)', 'IN (?)', 'gi')"
    out = rf"regexp_replace({out}, '''([^'']|'''')*''', '?', 'g')"
    out = rf"regexp_replace({out}, '\b\d+(\.\d+)?\b', '?', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def duck_strip(base: str) -> str:
    out = rf"regexp_replace({base}, '\s+and\s+is_deleted\s*=\s*\?', '', 'gi')"
    out = rf"regexp_replace({out}, '\s+and\s+tenant_id\s*=\s*\?', '', 'gi')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def duck_guess(base: str, db: str) -> str:
    ctes = rf"list_transform(regexp_extract_all({base}, '(?i)(?:^|\bwith\b|,)\s*([a-zA-Z0-9_]+)\s+as\s*\(', 1), lambda c: lower(c))"
    names = rf"regexp_extract_all({base}, '(?i)\bfrom\s+({_NAME}(?:\s*\.\s*{_NAME})*)', 1)"
    plain = rf"list_transform({names}, lambda n: replace(regexp_replace(n, '\s*\.\s*', '.', 'g'), '`', ''))"
    first = f"list_filter({plain}, lambda n: NOT list_contains({ctes}, lower(split_part(n, '.', 1))))[1]"
    return f"(CASE WHEN contains({first}, '.') OR coalesce({db}, '') = '' THEN {first} ELSE {db} || '.' || {first} END)"


# Views ``src`` (all records), ``t`` (templates) and ``r`` (fact rows) for the counterparts.
PRELUDE = f"""WITH src AS (SELECT {_SOURCE_SELECT} FROM events),
based AS (SELECT *, {duck_base('stmt_raw')} AS base FROM src),
acc AS (SELECT *, {duck_strip('base')} AS template FROM based WHERE base <> ''),
firsts AS (SELECT template, min(record_id) AS first_id FROM acc GROUP BY template),
t AS (SELECT 'events' AS dataset_id, CAST(row_number() OVER (ORDER BY first_id) AS INTEGER) AS stripped_template_id,
  f.template AS sql_template_stripped, {duck_guess('a.base', 'a.db_name')} AS table_guess
  FROM firsts f JOIN acc a ON a.record_id = f.first_id),
r AS (SELECT 'events' AS dataset_id, acc.*, t.stripped_template_id FROM acc JOIN t ON t.sql_template_stripped = acc.template)
"""
