"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

AUDIT_RECORDS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("record_id", T.LongType(), False),
        T.StructField("event_time_ms", T.LongType()),
        T.StructField("is_internal", T.BooleanType()),
        T.StructField("query_id", T.StringType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("fe_ip", T.StringType()),
        T.StructField("db_name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("query_time_ms", T.LongType()),
        T.StructField("cpu_time_ms", T.LongType()),
        T.StructField("scan_bytes", T.LongType()),
        T.StructField("scan_rows", T.LongType()),
        T.StructField("return_rows", T.LongType()),
        T.StructField("peak_memory_bytes", T.LongType()),
        T.StructField("workload_group", T.StringType()),
        T.StructField("cloud_cluster_name", T.StringType()),
        T.StructField("stmt_raw", T.StringType()),
        T.StructField("stripped_template_id", T.IntegerType()),
    ]
)

AUDIT_TEMPLATES = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("stripped_template_id", T.IntegerType(), False),
        T.StructField("sql_template_stripped", T.StringType(), False),
        T.StructField("table_guess", T.StringType()),
    ]
)

# Columns every log reader produces before templates are numbered.
PARSED_FIELDS = [
    "event_time_ms",
    "is_internal",
    "query_id",
    "user_name",
    "client_ip",
    "fe_ip",
    "db_name",
    "state",
    "error_code",
    "error_message",
    "query_time_ms",
    "cpu_time_ms",
    "scan_bytes",
    "scan_rows",
    "return_rows",
    "peak_memory_bytes",
    "workload_group",
    "cloud_cluster_name",
    "stmt_raw",
]
