import gzip
from datetime import datetime, timedelta, timezone

import pytest
from conftest import values
from pyspark.sql import Row
from pyspark.sql import functions as F

from querylens import ordering
from querylens.sources import detect, fe_log, ingest, lines, mysqldump, outfile, sinks
from querylens.sources.columns import POSITIONAL
from querylens.sources.lines import read_lines


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


# Records of our own making, rendered in the three formats and compared with what the readers return.
BASE = datetime(2027, 8, 14, 21, 30, 5, tzinfo=timezone.utc)
COLUMN = {name: place for place, name in enumerate(POSITIONAL) if name}
# Column names of a dump's column list.
DUMP_NAMES = {"user_name": "user", "db_name": "db", "query_time_ms": "query_time", "fe_ip": "frontend_ip", "cloud_cluster_name": "compute_group", "stmt_raw": "stmt"}
STATEMENTS = ["delete from cart where sku = 'k-%d'", "select avg(w) from reading where station in (%d, 4)", "update dock set berth = %d where free", "select %d"]
TEMPLATES = ["delete from cart where sku = ?", "select avg(w) from reading where station IN (?)", "update dock set berth = ? where free", "select ?"]


def record(i):
    return {
        "query_id": f"run-{i * 7919:05x}", "user_name": ["ada", "grace", "edsger"][i % 3], "client_ip": f"198.51.100.{i % 200}", "db_name": f"harbour_{i % 4}",
        "state": ["EOF", "OK", "ERR"][i % 3], "error_code": [0, 0, 1064][i % 3], "error_message": [None, None, f"line {i}"][i % 3], "query_time_ms": 17 * i + 1,
        "scan_bytes": 3 ** (i % 20), "scan_rows": i * i, "return_rows": i, "fe_ip": "192.0.2.77", "cpu_time_ms": 5 * i, "peak_memory_bytes": 1 << (i % 34),
        "workload_group": f"tier{i % 2}", "cloud_cluster_name": "north", "stmt_raw": STATEMENTS[i % 4] % i,
    }


def moment(i):
    return BASE + timedelta(seconds=41 * i, milliseconds=3 * i)


def cells(i, **other):
    """The texts of a positional row; the address has a port."""
    r = record(i) | other
    out = [""] * len(POSITIONAL)
    for name, place in COLUMN.items():
        value = moment(i).strftime("%Y-%m-%d %H:%M:%S.%f") if name == "time" else f"{r[name]}:{9000 + i}" if name == "client_ip" else r[name]
        out[place] = "" if value is None else str(value)
    return out


def csv_row(stmt="select 42", sep=",", width=29):
    return sep.join(cells(3, stmt_raw=stmt)[:width])


def quoted(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def check_records(rows, numbers):
    """Parsed rows equal the records they were rendered from."""
    assert len(rows) == len(numbers)
    for row, i in zip(rows, numbers):
        assert {name: row[name] for name in record(i)} == record(i)
        assert row.event_time_ms == round(moment(i).timestamp() * 1000)
        assert row.template == TEMPLATES[i % 4]


SHORT = "INSERT INTO `audit_log` (`query_id`,`time`,`client_ip`,`stmt`) VALUES "
NOW = f"'{moment(1):%Y-%m-%d %H:%M:%S}','198.51.100.9:40404'"


def test_blocks_and_crlf(spark, tmp_path):
    path = put(
        tmp_path,
        "a.log",
        "﻿junk\r\n2025-12-25 11:17:02,188 [query] |User=a|Stmt=select 1\r\nfrom t\rx\r\n"
        "2025-12-25 11:17:03.188 INFO [query] |User=b|Stmt=select 2|CpuTimeMS=2\n",
    )
    blocks = fe_log.record_blocks(read_lines(spark, path)).orderBy("record_seq")
    texts = [r.text for r in blocks.collect()]
    assert len(texts) == 3
    assert texts[0] == "junk"
    assert texts[1].endswith("|Stmt=select 1\nfrom t\rx")
    assert "User=b" in texts[2]


def test_log_records(spark, tmp_path):
    keys = {"user_name": "User", "db_name": "Db", "state": "State", "error_code": "ErrorCode", "error_message": "ErrorMessage", "query_time_ms": "Time(ms)", "scan_bytes": "ScanBytes",
            "scan_rows": "ScanRows", "return_rows": "ReturnRows", "fe_ip": "feIp", "cpu_time_ms": "CpuTimeMS", "peak_memory_bytes": "peakMemoryBytes", "workload_group": "workloadGroup", "cloud_cluster_name": "ComputeGroupName"}
    lines = []
    for i in range(9):
        r = record(i)
        pairs = [f"{k}={r[name]}" for name, k in keys.items() if r[name] is not None]
        lines.append(f"{moment(i):%Y-%m-%d %H:%M:%S},{3 * i:03d} [query] |IsInternal={str(i % 2 == 0).lower()}|Client={r['client_ip']}:{i + 1}|{'|'.join(pairs)}|QueryId={r['query_id']}|Stmt={r['stmt_raw']}|")
    rows = fe_log.read_fe_log(spark, put(tmp_path, "a.log", "\n".join(lines) + "\n")).orderBy("record_seq").collect()
    check_records(rows, range(9))
    assert [r.is_internal for r in rows] == [i % 2 == 0 for i in range(9)]


def test_log_entry_forms(spark, tmp_path):
    stamp = f"{BASE:%Y-%m-%d %H:%M:%S}"
    path = put(
        tmp_path,
        "a.log",
        f'{stamp}.000250 WARN [query] |queriedTablesAndViews=["harbour.dock","harbour.cart"]|QueryId=first|Stmt=select berth\n  from `harbour`.`dock`|CpuTimeMS=12|Digest=9f|\n'
        f"{stamp},000 [query] |User=ada|QueryId=second|User=grace\n",
    )
    first, second = fe_log.read_fe_log(spark, path).orderBy("record_seq").collect()
    assert (first.queried_tables, first.stmt_raw, first.cpu_time_ms) == ('["harbour.dock","harbour.cart"]', "select berth\n  from `harbour`.`dock`", 12)
    assert second.template is None and second.user_name == "grace"


@pytest.mark.parametrize("split_bytes", ["300", "134217728"])
def test_fe_ingest_is_split_invariant(spark, tmp_path, split_bytes):
    lines, expect = [], []
    for i in range(60):
        stamp = f"2025-12-25 11:00:{i:02d},{i:03d}"
        stmt = f"select {i}\n" + "x\r\n" * (i % 17) + f"from t{i % 3}"
        lines.append(f"{stamp} [query] |QueryId=q{i}|Db=d|Time(ms)={i}|Stmt={stmt}|")
        expect.append((f"q{i}", i))
        if i % 3 == 0:
            lines.append(f"{stamp} [slow_query] |QueryId=q{i}|Db=d|Time(ms)={i}|Stmt={stmt}|")
        if i % 10 == 0:
            lines.append(f"{stamp} [slow_query] |QueryId=s{i}|Db=d|Time(ms)=1|Stmt=select 1|")
            expect.append((f"s{i}", 1))
        if i % 30 == 0:
            lines.append(f"{stamp} [query] |QueryId=bad{i}|Db=d|")
    path = put(tmp_path, "fe.log", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        done = ingest.ingest(spark, path, "ds")
        rows = values(done.records.orderBy("record_id"), "record_id", "query_id", "query_time_ms")
        templates = values(done.templates.orderBy("stripped_template_id"), "stripped_template_id", "sql_template_stripped", "table_guess")
        report = done.report.collect()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == [(i, q, t) for i, (q, t) in enumerate(expect)]
    assert [t[0] for t in templates] == list(range(1, len(templates) + 1))
    # record 0 is the first query, record 1 the unmatched slow entry that follows it
    assert templates[:2] == [(1, "select ? from t0", "d.t0"), (2, "select ?", None)]
    assert (report.records_parsed, report.records_inserted, report.bad_records) == (len(expect) + 2, len(expect), 2)


def test_export_records(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "\n".join("\t".join(cells(i)) for i in range(8)) + "\n\n" + "\t".join(cells(8)[:-1]) + "\n")
    rows = outfile.read_outfile(spark, path, "\t").orderBy("record_seq").collect()
    assert [r.valid for r in rows] == [True] * 8 + [False]
    check_records(rows[:8], range(8))


def test_export_escapes_and_header(spark, tmp_path):
    escaped = put(tmp_path, "e.tsv", csv_row("select berth\\n from dock\\n where free = 2", "\t") + "\n")
    assert outfile.read_outfile(spark, escaped, "\t").collect()[0].stmt_raw == "select berth\n from dock\n where free = 2"
    names = ["stmt", "unknown", "query_id", "client_ip", "query_time", "time"]
    body = ["select 8", "?", "by-name", "198.51.100.1:5", "77", f"{BASE:%Y-%m-%d %H:%M:%S}"]
    lines = ["\t".join(x) for x in (cells(3), names, body, body[1:], names)]
    rows = outfile.read_outfile(spark, put(tmp_path, "b.tsv", "\n".join(lines)), "\t").orderBy("record_seq").collect()
    assert [(r.valid, r.query_id, r.query_time_ms, r.template) for r in rows] == [
        (True, record(3)["query_id"], record(3)["query_time_ms"], TEMPLATES[3]),
        (True, "by-name", 77, "select ?"),
        (False, None, None, None),
        (True, "query_id", None, "stmt"),
    ]


def dump_rows(spark, path):
    read = mysqldump.read_parts(spark, path)
    recs = mysqldump.tuple_records(read).orderBy("statement_seq", "tuple_pos").collect()
    return mysqldump.parse_inserts(read).orderBy("statement_seq").collect(), recs


def test_dump_records(spark, tmp_path):
    listed = [name for name in COLUMN if name != "scan_rows"]
    named = ",".join(f"`{DUMP_NAMES.get(n, n)}`" for n in listed)

    def tuple_of(i, places, rest):
        texts = cells(i)
        return "(" + ", ".join(rest if p is None else "NULL" if texts[p] == "" else quoted(texts[p]) for p in places) + ")"

    by_name = ",\n".join(tuple_of(i, [COLUMN[n] for n in listed], "") for i in range(5))
    by_place = ",".join(tuple_of(i, [p if POSITIONAL[p] else None for p in range(len(POSITIONAL))], "0") for i in range(5, 9))
    sql = f"SET NAMES utf8mb4;\nINSERT INTO `audit_log` ({named}) VALUES\n{by_name};\nINSERT INTO `harbour` VALUES (1);\nINSERT IGNORE INTO `x`.`audit_log` VALUES {by_place};\n"
    _, rows = dump_rows(spark, put(tmp_path, "d.sql", sql))
    assert [r.scan_rows for r in rows[:5]] == [None] * 5
    check_records([r if k >= 5 else Row(**(r.asDict() | {"scan_rows": k * k})) for k, r in enumerate(rows)], range(9))


def test_dump_strings(spark, tmp_path):
    sql = (
        f"{SHORT}('a',{NOW},'begin; commit');\n{SHORT}('b',{NOW},'tab\\t back\\\\slash\\n'), ( 'c' , {NOW} , 'o''clock;\n on' ) ;"
        f"{SHORT}('d',{NOW},uuid()),"
    )
    ins, rows = dump_rows(spark, put(tmp_path, "d.sql", sql))
    assert [(r.query_id, r.stmt_raw) for r in rows] == [("a", "begin; commit"), ("b", "tab\t back\\slash"), ("c", "o'clock;\n on"), ("d", "uuid(")]
    assert [i.reason for i in ins] == [None, None, "something else than a comma or the end follows a tuple"]


def test_dump_rejects(spark, tmp_path):
    cases = [
        (f"({NOW},'x','y')", None),
        (f"('kept',{NOW},'select 3'), ('open',{NOW}", "tuple cannot be read"),
    ]
    heads = [("(stmt query_id) VALUES ('a','b')", "column list cannot be read"), ("(stmt) TABLE other", "VALUES is missing"), ("VALUES ROW(7)", "no tuple begins where one should")]
    sql = "".join(f"{SHORT}{values};\n" for values, _ in cases) + "".join(f"INSERT INTO audit_log {head};\n" for head, _ in heads)
    path = put(tmp_path, "d.sql", sql)
    ins, rows = dump_rows(spark, path)
    assert [r.stmt_raw for r in rows] == ["y", "select 3"]
    assert [(i.statement_seq, i.reason) for i in ins] == list(enumerate(r for _, r in cases + heads))
    report = ingest.ingest(spark, path, "ds").report.collect()[0]
    assert (report.format_detected, report.bad_statements, report.statements_scanned) == ("auditLogMysqlDump", 4, 5)


@pytest.fixture
def short_runs(monkeypatch):
    monkeypatch.setattr(lines, "RUN_BITS", 1)


@pytest.mark.parametrize("split_bytes", ["150", "1000", "134217728"])
def test_dump_of_one_statement(spark, tmp_path, split_bytes, short_runs):
    """One INSERT is the whole file; tuples cross lines and splits, and only the broken one and what follows it are left out."""
    bodies = [f"row {i};\n) it''s, (" + "v" * (i % 7) * 40 for i in range(60)]
    tuples = [f"('w{i}',\n {NOW} ,'{body}')" for i, body in enumerate(bodies)]
    columns = "(`query_id`, `a)b`, `stmt`)"
    texts = {
        "whole": f"{SHORT}" + ",\n".join(tuples) + ";\n",
        "broken": f"{SHORT}" + ",".join(tuples[:50]) + f",('open' {NOW}, ,'x')," + ",".join(tuples[50:]) + ";\n",
        "named": f"/* of a tool */;INSERT INTO audit_log {columns}\nVALUES " + ", ".join(f"('n{i}', NULL, '{b}')" for i, b in enumerate(bodies)),
    }
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        found = {name: dump_rows(spark, put(tmp_path, f"{name}.sql", text)) for name, text in texts.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    expect = [b.replace("''", "'") for b in bodies]
    assert [(r.query_id, r.stmt_raw) for r in found["whole"][1]] == [(f"w{i}", b) for i, b in enumerate(expect)]
    assert [r.tuple_pos for r in found["whole"][1]] == list(range(60)) and [i.reason for i in found["whole"][0]] == [None]
    assert [r.query_id for r in found["broken"][1]] == [f"w{i}" for i in range(50)]
    assert [(i.reason, i.stopped_at) for i in found["broken"][0]] == [("tuple cannot be read", f",('open' {NOW}, ,'x')")]
    assert [(r.query_id, r.stmt_raw) for r in found["named"][1]] == [(f"n{i}", b) for i, b in enumerate(expect)]


@pytest.mark.parametrize("split_bytes", ["150", "134217728"])
def test_dump_is_split_invariant(spark, tmp_path, split_bytes, short_runs):
    stmts, expect = [], []
    for i in range(20):
        body = "a;\n b''c \\' d;\n" * (i % 5) + "it''s;"
        stmts.append(f"{SHORT}\n('q{i}',{NOW},'{body}'),\n('r{i}',{NOW},'select {i}');")
        expect += [(f"q{i}", ("a;\n b'c ' d;\n" * (i % 5) + "it's;")), (f"r{i}", f"select {i}")]
    path = put(tmp_path, "d.sql", "SET NAMES utf8mb4;\n" + "\n".join(stmts) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        done = ingest.ingest(spark, path, "ds")
        rows = values(done.records.orderBy("record_id"), "query_id", "stmt_raw")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == expect


def test_noise(spark, tmp_path):
    sql = f"{SHORT}('q-noise',{NOW},'select @@version_comment limit 1'),('q-user',{NOW},'select * from orders where o_orderkey = 1');"
    done = ingest.ingest(spark, put(tmp_path, "d.sql", sql), "ds")
    r = done.report.collect()[0]
    assert (r.records_inserted, r.bad_records, r.filtered_records) == (1, 0, 1)
    df = spark.createDataFrame([(s,) for s in ["SHOW VARIABLES LIKE 'gtid_mode'", "set session net_read_timeout=600",
                                               "START TRANSACTION", "", None]], "s string")
    assert [r[0] for r in df.select(mysqldump.is_noise(F.col("s"))).collect()] == [True, True, False, False, False]


def test_detect(spark, tmp_path):
    filler = "INSERT INTO `orders` VALUES (" + ",".join(["NULL"] * 29) + ");\n"
    marker = f"{SHORT}('q',{NOW},'select 1');\n"
    cases = {
        "fe.log": ("2025-12-25 11:17:02,188 [query] |Stmt=insert into audit_log values (1)|\n", "feAuditLog", None),
        "dump.sql": (marker, "auditLogMysqlDump", None),
        "create.sql": ("-- head\nCREATE TABLE `__internal`.`audit_log` (`id` int);\n", "auditLogMysqlDump", None),
        "marker_in_csv.csv": (csv_row("select 42; insert into audit_log values (1)") + "\n", "auditLogOutfileCsv", ","),
        "late.sql": (filler * 9000 + marker, "auditLogMysqlDump", None),
        "noaudit.sql": (filler, "auditLogOutfileCsv", ","),
        "a.tsv": ("\n" + csv_row(sep="\t") + "\n", "auditLogOutfileCsv", "\t"),
        "header.csv": ("query_id,time,client_ip\n", "auditLogOutfileCsv", ","),
        "plain.txt": ("hello\n", "feAuditLog", None),
    }
    for name, (text, _, _) in cases.items():
        put(tmp_path, name, text)
    got = {r.file.rsplit("/", 1)[1]: (r.format, r.delimiter) for r in detect.detect_formats(read_lines(spark, str(tmp_path))).collect()}
    assert got == {name: (fmt, d) for name, (_, fmt, d) in cases.items()}


def test_export_that_begins_with_short_lines(spark, tmp_path):
    filler = "INSERT INTO `orders` VALUES (" + ",".join(["NULL"] * 29) + ");\n"
    cases = {
        "short.csv": ("q0,x\n\n" + csv_row("select 7") + "\n" + csv_row("select 8") + "\n", "auditLogOutfileCsv", ","),
        "short.tsv": ("q0\tx\n" * 3 + csv_row("select 9", sep="\t") + "\n", "auditLogOutfileCsv", "\t"),
        "script.sql": ("-- head\n" + filler, "feAuditLog", None),
    }
    for name, (text, _, _) in cases.items():
        put(tmp_path, name, text)
    got = {r.file.rsplit("/", 1)[1]: (r.format, r.delimiter) for r in detect.detect_formats(read_lines(spark, str(tmp_path))).collect()}
    assert got == {name: (fmt, d) for name, (_, fmt, d) in cases.items()}
    done = ingest.ingest(spark, [str(tmp_path / "short.csv"), str(tmp_path / "short.tsv")], "ds")
    assert sorted(r.stmt_raw for r in done.records.collect()) == ["select 7", "select 8", "select 9"]
    assert sorted((r.records_inserted, r.bad_records) for r in done.report.collect()) == [(1, 3), (2, 1)]


def test_long_statement_is_stored_whole(spark, tmp_path):
    stmt = "select '" + "y" * 5000 + "' from t"
    done = ingest.ingest(spark, put(tmp_path, "f.log", f"2025-12-25 11:17:02,188 [query] |QueryId=a|Stmt={stmt}|\n"), "ds")
    r = done.records.collect()[0]
    assert r.stmt_raw == stmt
    assert done.templates.collect()[0].sql_template_stripped == "select ? from t"


def test_sinks_round_trip(spark, tmp_path):
    rows = [("a", 1, "x\ty\\z\n", None), ("b", 2, "", "#c"), (" lead", 3, '"q"', "d ")]
    df = spark.createDataFrame(rows, "query_id string, n long, t string, u string").coalesce(1)
    out = str(tmp_path / "tsv")
    sinks.write_tsv(df, out)
    text = [r.value for r in spark.read.text(out, lineSep="\n").collect()]
    assert text == ["query_id\tn\tt\tu", "a\t1\tx\\ty\\\\z\\n\t\\N", "b\t2\t\t#c", ' lead\t3\t"q"\td ']

    log = put(tmp_path, "f.log", "".join(
        f"2025-12-25 11:17:{i:02d},188 [query] |QueryId=q{i}|Stmt=select {i} from t{i % 2}|\n" for i in range(20)))
    done = ingest.ingest(spark, log, "one")
    target = str(tmp_path / "records")
    sinks.write_records(done.records, target)
    sinks.write_records(done.records.withColumn("dataset_id", F.lit("two")), target)
    sinks.write_records(done.records.where("record_id < 5"), target)
    assert values(spark.read.parquet(target).groupBy("dataset_id").count().orderBy("dataset_id")) == [("one", 5), ("two", 20)]
    dims = str(tmp_path / "templates")
    sinks.write_templates(done.templates, dims)
    more = done.templates.withColumn("stripped_template_id", F.col("stripped_template_id") + 1)
    sinks.append_templates(more, dims)
    assert spark.read.parquet(dims).count() == 3


def test_first_error_code_that_can_be_read(spark, tmp_path):
    log = "".join(
        f"2026-03-0{i + 1} 07:08:09,100 [query] |QueryId=n{i}|{codes}|Stmt=select {i}|\n"
        for i, codes in enumerate(["ErrorCode=abc|error_code=7", "ErrorCode=|error_code=8", "ErrorCode=5|error_code=9", "ErrorCode=abc"])
    )
    done = ingest.ingest(spark, put(tmp_path, "codes.log", log), "ds")
    assert [r.error_code for r in done.records.orderBy("record_id").collect()] == [7, 8, 5, None]


def test_format_does_not_depend_on_splits(spark, tmp_path):
    put(tmp_path, "mixed.txt", csv_row("select 7") + "\n" + "filler, with commas\n" * 150 + "2026-03-01 07:08:09,100 [query] |QueryId=z|Stmt=select 1|\n")
    put(tmp_path, "late.txt", csv_row("select 7") + "\n" + "é" * 140_000 + "\n|Stmt=beyond the head|\n")
    found = []
    for size in ("1000b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = detect.detect_formats(read_lines(spark, str(tmp_path))).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        found.append({r.file.rsplit("/", 1)[1]: r.format for r in rows})
    assert found[0] == found[1] == {"mixed.txt": "feAuditLog", "late.txt": "auditLogOutfileCsv"}


def test_rows_without_time_are_spread(spark, tmp_path):
    rows = spark.range(4000).selectExpr("'ds' AS dataset_id", "id AS record_id", "CASE WHEN id % 2 = 0 THEN id END AS event_time_ms")
    target = str(tmp_path / "spread")
    sinks.write_records(rows, target, 8)
    sizes = [r["count"] for r in spark.read.parquet(target).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * min(sizes) and sum(sizes) == 4000


@pytest.mark.parametrize("bits", [2, 12])
def test_runs_of_a_packed_log(spark, tmp_path, monkeypatch, bits):
    """A compressed log is one split; its runs give the same entries, twins and ids, whatever their length."""
    monkeypatch.setattr(lines, "RUN_BITS", bits)
    entries, expect = [], []
    for i in range(40):
        stmt = f"select {i}" + "\n, more" * (i % 9)
        tag = "slow_query" if i % 4 == 3 else "query"
        number = i - 1 if i % 4 == 3 else i
        entries.append(f"2031-07-05 08:00:{i:02d},250 [{tag}] |QueryId=z{number}|Time(ms)={i}|Stmt={stmt}")
        if i % 4 != 3:
            expect.append((f"z{number}", stmt))
    text = "lines of an entry\n|QueryId=z9|Stmt=cut off\n" * 5 + "\n".join(entries) + "\n"
    packed = tmp_path / "log.gz"
    packed.write_bytes(gzip.compress(text.encode()))
    read = lines.read_lines(spark, str(packed))
    longest = read.groupBy(*lines.LINES.keys).count().agg({"count": "max"}).first()[0]
    assert longest <= 2**bits
    bare = fe_log.record_blocks(read, lead=False).orderBy("record_seq").collect()
    blocks = fe_log.record_blocks(read).orderBy("record_seq").collect()
    assert [b.record_seq for b in blocks] == list(range(41)) and bare[0].text is None and blocks[1:] == bare[1:]
    assert blocks[0].text == text[: text.index("\n2031")]
    assert [b.text for b in blocks[1:]] == entries
    done = ingest.ingest(spark, str(packed), "ds", formats={r.file: ("feAuditLog", None) for r in read.select("file").distinct().collect()})
    rows = done.records.orderBy("record_id").collect()
    assert [(r.query_id, r.stmt_raw) for r in rows] == expect and [r.record_id for r in rows] == list(range(30))
    report = done.report.first()
    assert (report.records_parsed, report.records_inserted, report.bad_records) == (31, 30, 1)


@pytest.mark.parametrize("group", [("g",), ()])
def test_what_comes_before_a_bucket(spark, group):
    """Sums and last values equal those of one loop over all buckets, within groups and without any."""
    lanes = ordering.Buckets(group, ("a", "b", "c") if group else ("g", "a", "b", "c"), ("c",))
    rows = [(g, a, b, c, (7 * a + 3 * b + c) % 5 - 1 or None) for g in "xy" for a in range(3) for b in range(1 + a) for c in range(4)]
    df = spark.createDataFrame(rows, "g string, a long, b long, c long, v long")
    got = ordering.before_buckets(df, lanes, sums={"total": F.col("v")}, lasts={"last": F.when(F.col("v") > 2, F.struct("a", "v"))})
    expect, total, last = [], 0, None
    for i, row in enumerate(sorted(rows, key=lambda r: r[:4])):
        if group and i == len(rows) // 2:
            total, last = 0, None
        expect.append((*row, total, last))
        total += row[4] or 0
        last = (row[1], row[4]) if (row[4] or 0) > 2 else last
    found = [tuple(r[c] for c in (*"gabcv", "total")) + (r["last"] and tuple(r["last"]),) for r in got.collect()]
    assert sorted(found, key=lambda r: r[:4]) == expect


def test_lines_of_an_export_are_not_dealt_by_file(spark, tmp_path):
    """One file may hold most lines: the header must come to them, not they to the header."""
    header = "query_id,time,client_ip,stmt"
    put(tmp_path, "a.csv", "\n".join([header, *(f'q{i},2025-12-25 11:17:02,198.51.100.7:1,"say ""{i}"", then"' for i in range(20))]))
    put(tmp_path, "b.csv", csv_row())
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = outfile.read_outfile(spark, str(tmp_path), ",")
        assert "hashpartitioning(file" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(values(rows, "query_id", "stmt_raw")) == sorted([*((f"q{i}", f'say "{i}", then') for i in range(20)), (record(3)["query_id"], "select 42")])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
