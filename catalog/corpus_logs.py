"""The audit records of ``corpus_audit`` rendered as log files in every supported format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog.corpus_audit import audit_source
from catalog.registry import stored
from querylens.session import scratch_dir
from querylens.sources.columns import POSITIONAL
from querylens.sources.ingest import Ingested, ingest
from querylens.sources.sinks import tsv_rows, write_tsv

FILES = 4
STATEMENT_ROWS = 50

EXPORT_HEADER = {
    "query_id": "query_id",
    "time": "time",
    "client_ip": "client_ip",
    "user": "user_name",
    "catalog": None,
    "db": "db_name",
    "state": "state",
    "error_code": "error_code",
    "error_message": "error_message",
    "query_time": "query_time_ms",
    "scan_bytes": "scan_bytes",
    "scan_rows": "scan_rows",
    "return_rows": "return_rows",
    "frontend_ip": "fe_ip",
    "cpu_time_ms": "cpu_time_ms",
    "peak_memory_bytes": "peak_memory_bytes",
    "workload_group": "workload_group",
    "compute_group": "cloud_cluster_name",
    "stmt": "stmt_raw",
}


def _in_order(df: DataFrame) -> DataFrame:
    """Files in record order, so that file order is record order."""
    return df.repartitionByRange(FILES, "record_id").sortWithinPartitions("record_id")


def _address() -> Column:
    return F.concat(F.col("client_ip"), F.lit(":5"), (F.col("record_id") % 1000).cast("string"))


def _stamp(pattern: str) -> Column:
    return F.date_format(F.timestamp_millis("event_time_ms"), pattern)


def fe_entries(rows: DataFrame) -> DataFrame:
    """``value``: entry text. Every 5th query has a slow twin, every 13th is logged as slow only."""

    def kv(name: str, column: str | Column) -> Column:
        value = F.col(column) if isinstance(column, str) else column
        return F.coalesce(F.concat(F.lit(f"|{name}="), value.cast("string")), F.lit(""))

    body = F.concat(
        F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("|Timestamp="), _stamp("yyyy-MM-dd HH:mm:ss.SSS"))).otherwise(
            F.lit("")
        ),
        kv("IsInternal", "is_internal"),
        kv("Client", _address()),
        kv("User", "user_name"),
        kv("FeIp", "fe_ip"),
        kv("Db", "db_name"),
        kv("State", "state"),
        kv("ErrorCode", "error_code"),
        kv("ErrorMessage", "error_message"),
        kv("Time(ms)", "query_time_ms"),
        kv("ScanBytes", "scan_bytes"),
        kv("ScanRows", "scan_rows"),
        kv("ReturnRows", "return_rows"),
        kv("QueryId", "query_id"),
        kv("CpuTimeMS", "cpu_time_ms"),
        kv("PeakMemoryBytes", "peak_memory_bytes"),
        kv("WorkloadGroup", "workload_group"),
        kv("CloudClusterName", "cloud_cluster_name"),
        kv("Stmt", "stmt_raw"),
        F.lit("|"),
    )
    prefix = F.when(F.col("record_id") % 3 == 0, _stamp("yyyy-MM-dd HH:mm:ss,SSS")).otherwise(
        F.concat(_stamp("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" INFO"))
    )
    slow_only = F.col("record_id") % 13 == 0
    tags = (
        F.when(slow_only, F.array(F.lit("slow_query")))
        .when(F.col("record_id") % 5 == 0, F.array(F.lit("query"), F.lit("slow_query")))
        .otherwise(F.array(F.lit("query")))
    )
    return _in_order(rows).select(F.explode(tags).alias("tag"), prefix.alias("p"), body.alias("b")).select(
        F.concat("p", F.lit(" ["), "tag", F.lit("] "), "b").alias("value")
    )


def _export_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time", _stamp("yyyy-MM-dd HH:mm:ss.SSSSSS")).withColumn("client_ip", _address())


def _positional(rows: DataFrame) -> DataFrame:
    cells = [F.col(name) if name else F.lit("0") for name in POSITIONAL]
    return _in_order(_export_columns(rows)).select(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(cells)])


def _csv_lines(rows: DataFrame) -> DataFrame:
    """Comma form: every field quoted, quotes doubled; one line in 100 has too few fields."""
    cells = tsv_rows(_positional(rows))
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in cells.columns]
    whole = F.concat_ws(",", *quoted)
    short = F.concat_ws(",", *quoted[:20])
    # c10 carries scan_bytes = record_id * 1024
    broken = (F.col("c10").cast("bigint") / 1024) % 100 == 7
    return cells.select(F.when(broken, short).otherwise(whole).alias("value"))


_DUMP_FIELDS = {
    "`isinternal`": "is_internal",
    "`query_id`": "query_id",
    "`time`": "time",
    "`client`": "client_ip",
    "`user`": "user_name",
    "`unused`": None,
    "`db`": "db_name",
    "`state`": "state",
    "`error_code`": "error_code",
    "`error_message`": "error_message",
    "`time(ms)`": "query_time_ms",
    "`scan_bytes`": "scan_bytes",
    "`scan_rows`": "scan_rows",
    "`return_rows`": "return_rows",
    "`frontend_ip`": "fe_ip",
    "cpu_time_ms": "cpu_time_ms",
    "`peak_memory_bytes`": "peak_memory_bytes",
    "`workload_group`": "workload_group",
    "`compute_group`": "cloud_cluster_name",
    "`stmt`": "stmt_raw",
}


def _dump_tuples(rows: DataFrame, named: Column, group: Column) -> DataFrame:
    """``g, record_id, t``: a tuple for each record, by the column list where ``named`` holds and else by place; some follow a probe of the dump client."""

    def literal(column: str | None) -> Column:
        if column is None:
            return F.lit("NULL")
        kind = typed[column]
        if kind != "string":
            return F.coalesce(F.col(column).cast("string"), F.lit("NULL"))
        text = F.replace(F.col(column), F.lit("\\"), F.lit("\\\\"))
        text = F.replace(text, F.lit("'"), F.lit("\\'"))
        # line breaks as an escape in one half of the records, as they are in the other
        escaped = F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
        text = F.when(F.col("record_id") % 2 == 0, escaped).otherwise(text)
        return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))

    source = _export_columns(rows)
    typed = dict(source.dtypes)
    in_list = F.concat(F.lit("("), F.concat_ws(", ", *[literal(c) for c in _DUMP_FIELDS.values()]), F.lit(")"))
    by_place = F.concat(F.lit("("), F.concat_ws(",", *[literal(c) for c in POSITIONAL]), F.lit(")"))
    probe = F.lit("SHOW VARIABLES LIKE \\'gtid_mode\\'")
    noise_list = ["NULL"] * len(_DUMP_FIELDS)
    noise_place = ["NULL"] * len(POSITIONAL)
    noise = F.when(
        named, F.concat(F.lit("(" + ", ".join(noise_list[:-1]) + ", '"), probe, F.lit("'),\n"))
    ).otherwise(F.concat(F.lit("(" + ",".join(noise_place[:-1]) + ",'"), probe, F.lit("'),\n")))
    one = F.concat(
        F.when(F.col("record_id") % 71 == 0, noise).otherwise(F.lit("")),
        F.when(named, in_list).otherwise(by_place),
    )
    return source.select(group.alias("g"), "record_id", one.alias("t"))


def dump_statements(rows: DataFrame) -> DataFrame:
    """``value``: one INSERT per 50 records.

    Even groups name their columns, odd ones rely on the default order. Every 71st record follows
    a probe of the dump client, every 10th group ends in an unfinished tuple.
    """
    group = F.floor(F.col("record_id") / STATEMENT_ROWS)
    tuples = _dump_tuples(rows, group % 2 == 0, group)
    joined = tuples.groupBy("g").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("record_id", "t"))), lambda r: r["t"]), ","
        ).alias("tuples")
    )
    head = F.when(
        F.col("g") % 2 == 0, F.lit(f"INSERT INTO `audit_log` ({', '.join(_DUMP_FIELDS)}) VALUES ")
    ).otherwise(F.lit("INSERT IGNORE INTO `stats`.`audit_log` VALUES\n"))
    tail = F.when(F.col("g") % 10 == 9, F.lit(",('unfinished';")).otherwise(F.lit(";"))
    lines = joined.select("g", F.concat(head, "tuples", tail).alias("value"))
    # Some statements share a line with another one.
    with_other = F.when(F.col("g") % 3 == 0, F.concat(F.lit("SET NAMES utf8mb4; "), F.col("value"))).otherwise(F.col("value"))
    return lines.withColumn("value", with_other).repartitionByRange(FILES, "g").sortWithinPartitions("g").select("value")


def dump_single_inserts(rows: DataFrame) -> DataFrame:
    """A few INSERT statements that hold the whole table between them, a tuple a line."""
    group = F.pmod(F.xxhash64("record_id"), F.lit(FILES)).cast("long")
    tuples = _dump_tuples(rows, F.lit(True), group)
    firsts = tuples.groupBy("g").agg(F.min("record_id").alias("first"))
    comma = F.when(F.col("record_id") > F.col("first"), F.lit(",")).otherwise(F.lit(""))
    lines = tuples.join(firsts, "g").select("g", "record_id", F.concat(comma, "t").alias("value"))
    head = firsts.select("g", F.lit(-1).cast("long").alias("record_id"), F.lit(f"INSERT INTO `audit_log` ({', '.join(_DUMP_FIELDS)}) VALUES").alias("value"))
    tail = firsts.select("g", F.lit((1 << 63) - 1).alias("record_id"), F.lit(";").alias("value"))
    return head.unionByName(lines).unionByName(tail).repartition(FILES, "g").sortWithinPartitions("g", "record_id").select("value")


def _write(df: DataFrame, path: str, compression: str = "none") -> str:
    df.write.option("lineSep", "\n").text(path, compression=compression)
    return path


def corpus(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Folder of the rendered files of one format, written once per application."""

    def build() -> str:
        rows = audit_source(spark, sf_dir)
        path = f"{scratch_dir(spark, 'logs')}/{kind}"
        if kind == "fe":
            return _write(fe_entries(rows), path)
        if kind == "fe-packed":
            return _write(fe_entries(rows), path, compression="gzip")
        if kind == "dump":
            return _write(dump_statements(rows), path)
        if kind == "dump-single":
            return _write(dump_single_inserts(rows), path)
        if kind == "csv":
            return _write(_csv_lines(rows), path)
        if kind == "tsv":
            return _write(tsv_rows(_positional(rows)).select(F.concat_ws("\t", "*").alias("value")), path)
        header = _in_order(_export_columns(rows)).select(
            *[(F.col(c) if c else F.lit("internal")).alias(name) for name, c in EXPORT_HEADER.items()]
        )
        write_tsv(header, path)
        return path

    return stored(spark, sf_dir, f"corpus-{kind}", build)


def ingested(spark: SparkSession, sf_dir: str, kind: str) -> Ingested:
    return stored(
        spark, sf_dir, f"ingested-{kind}", lambda: ingest(spark, corpus(spark, sf_dir, kind), dataset_id="events")
    )
