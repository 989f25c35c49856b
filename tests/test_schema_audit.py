from datetime import datetime

import pytest
from pyspark.sql import functions as F

from querylens.schema_audit import detail, findings, future, inputs, rules, scan, timeline
from querylens.schema_audit.ddl import descriptor_columns

AS_OF = datetime(2026, 2, 26, 5, 15)
GIB = 1024**3
DYN = {"enable": "true", "end": "8", "time_unit": "DAY", "prefix": "p", "time_zone": "Asia/Shanghai"}
PARTS = "database string, table string, pos int, name string, rows bigint, data_size bigint, buckets int, range string"


def parts_df(spark, tables):
    """{table: [(name, empty, size, buckets, lower)]}"""
    rows = []
    for table, parts in tables.items():
        for i, p in enumerate(parts):
            name, empty, size, buckets, lower = (list(p) + [None, None, ""][len(p) - 2:])[:5]
            size = (0 if empty else 2 * GIB) if size is None else size
            rng = f"[types: [DATETIMEV2]; keys: [{lower}]; ..types: [DATETIMEV2]; keys: [x]; )" if lower else None
            rows.append(("d", table, i, name, 0 if empty else 5, size, 1 if buckets is None else buckets, rng))
    return inputs.typed_partitions(spark.createDataFrame(rows, PARTS))


def props_df(spark, tables):
    rows = [("d", t, f"dynamic_partition.{k}", v) for t, p in tables.items() for k, v in p.items()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, property_name string, property_value string")


def audit(spark, tables, props=None, ddl=None):
    ddl_rows = [("d", t, (ddl or {}).get(t, "CREATE TABLE t (...)")) for t in tables]
    ddl_df = inputs.ddl_text(spark.createDataFrame(ddl_rows, "database string, table string, create_table string"))
    df = detail.schema_audit_detail(ddl_df, parts_df(spark, tables), props_df(spark, props) if props else None, AS_OF)
    return {r.table: ({f.rule_id: f for f in r.findings}, r.score) for r in df.collect()}


def days(year, n, empty, first=1):
    return [(f"p{year}01{i:02d}", empty(i) if callable(empty) else empty) for i in range(first, first + n)]


def test_empty_rules(spark):
    tail = [("z_old", False, None, None, "2026-01-01 00:00:00")]
    tail += [(f"a{i:02d}", True, None, None, f"2026-01-{i + 1:02d} 00:00:00") for i in range(1, 8)]
    partial = [("manual", False)] + [(f"p{i:02d}", True, None, None, f"2026-01-{i:02d}") for i in range(1, 8)]
    tables = {
        "future_tail": days(2000, 8, False) + days(2099, 8, True),
        "past_tail": days(2000, 20, lambda i: i > 10) + days(2099, 8, True),
        "by_range": tail,
        "partial": partial,
        "future_only": days(2000, 10, False) + days(2099, 10, True),
        "mixed": days(2000, 20, lambda i: i > 5) + days(2099, 10, True),
        "unclear": [(f"p{i:02d}", i > 5) for i in range(1, 31)],
        "range_first": [("m_old", False, None, None, "2000-01-01 00:00:00"), ("m_new", True, None, None, "2099-01-01 00:00:00")],
        "odd_name": [("p20000101", False), ("p20000102", False), ("p20990101", True), ("p20990102", True), ("p20990103", True), ("manual", True)],
    }
    dynamic = ["future_tail", "past_tail", "future_only", "mixed", "unclear", "range_first", "odd_name"]
    got = audit(spark, tables, {t: {**DYN, "end": "10"} for t in dynamic})
    rule = {t: f for t, (f, _) in got.items()}
    assert "SA-E002" not in rule["future_tail"]
    assert rule["past_tail"]["SA-E002"].numbers["emptyTailCount"] == 10
    assert rule["by_range"]["SA-E002"].details["orderSource"] == "range_lower"
    assert rule["by_range"]["SA-E002"].confidence == 0.9
    assert rule["partial"]["SA-E002"].details["orderSource"] == "range_lower_partial"
    assert rule["partial"]["SA-E002"].confidence == 0.75
    assert not {"SA-E001", "SA-D004"} & set(rule["future_only"])
    assert {"SA-E001", "SA-D004"} <= set(rule["mixed"])
    e001 = rule["mixed"]["SA-E001"]
    assert (e001.numbers["totalPartitions"], e001.numbers["emptyPartitions"], e001.numbers["rawTotalPartitions"]) == (20, 15, 30)
    assert rule["unclear"]["SA-E001"].confidence == 0.75
    assert "SA-E001" not in rule["range_first"]
    assert rule["odd_name"]["SA-E001"].details["futureExclusionSource"] == "unrecognized_no_exclusion"


def test_timeline_moves_dated_partitions_among_their_places(spark):
    df = parts_df(spark, {"t": [("anchor", False), ("a", True, None, None, "2026-01-03"), ("z", True, None, None, "2026-01-01"), ("b", True, None, None, "2026-01-02")]})
    df = timeline.timeline(df.withColumn("lower_us", future.lower_bound_us(F.col("range_lower"))))
    assert [r.name for r in df.orderBy("ord").collect()] == ["anchor", "z", "b", "a"]


def test_bucket_rules(spark):
    hashed = "CREATE TABLE t (...) DISTRIBUTED BY HASH(`id`) BUCKETS 1"
    auto = "CREATE TABLE t (...) DISTRIBUTED BY HASH(`id`) BUCKETS AUTO"
    one = [("p20260224", False, GIB, 2)]
    tables = {
        "small": [("p20260224", False, 50 * GIB, 1)],
        "large": [("p20260224", False, GIB, 10)],
        "jump": [("p1", False, 0, 2), ("p2", False, 0, 8), ("p3", False, 0, 8)],
        "jump_order": [("z", False, 0, 2, "2026-01-01"), ("b", False, 0, 4, "2026-01-02"), ("a", False, 0, 3, "2026-01-03")],
        "jump_partial": [("anchor", False, 0, 1), ("a", False, 0, 3, "2026-01-03"), ("z", False, 0, 2, "2026-01-01"), ("b", False, 0, 8, "2026-01-02")],
        "random": one,
        "mismatch": one,
        "missing": [("p1", True, 0, 0), ("p2", True, 0, 0)],
        "tablet": [("p1", False, 10 * GIB, 40)],
        "nothing": [],
    }
    ddl = {t: hashed for t in tables} | {t: auto for t in ("jump", "jump_order", "jump_partial")}
    ddl["random"] = "CREATE TABLE `t` (`k1` bigint) ENGINE=OLAP UNIQUE KEY(`k1`) DISTRIBUTED BY RANDOM BUCKETS 2"
    ddl["mismatch"] = "CREATE TABLE `t` (`k1` bigint, `k2` bigint) ENGINE=OLAP UNIQUE KEY(`k1`) DISTRIBUTED BY HASH(`k2`) BUCKETS 2"
    ddl["nothing"] = ddl["random"]
    got = audit(spark, tables, ddl=ddl)
    ids = {t: set(f) for t, (f, _) in got.items()}
    assert {"SA-B001", "SA-B009"} <= ids["small"]
    assert '"expectedMin":5,"expectedMax":10,"lowerBound":2,"upperBound":15' in got["small"][0]["SA-B001"].details["samples"]
    assert "SA-B002" in ids["large"]
    assert got["jump"][0]["SA-B003"].numbers["jumpCount"] == 1
    assert got["jump_order"][0]["SA-B003"].details["orderSource"] == "range_lower"
    assert got["jump_partial"][0]["SA-B003"].confidence == 0.75
    assert {"SA-B005", "SA-B009"} <= ids["random"]
    assert got["mismatch"][0]["SA-B006"].severity == "critical"
    assert got["missing"][0]["SA-B004"].severity == "warn"
    assert "SA-B007" in ids["tablet"]
    assert ids["nothing"] == {"SA-B005"}


def test_descriptor(spark):
    sql = "CREATE TABLE `t` (\n `id` bigint\n) ENGINE=OLAP\nUNIQUE KEY(`id`, `ts`)\nDISTRIBUTED BY HASH(`id`) BUCKETS AUTO\nPROPERTIES ()"
    r = spark.createDataFrame([(sql,)], "s string").select(*[c.alias(n) for n, c in descriptor_columns(F.col("s")).items()]).collect()[0]
    assert (r.keys_type, r.key_columns, r.distribution, r.dist_columns, r.auto_bucket) == ("unique", ["id", "ts"], "hash", ["id"], True)


def one(spark, sql_or_col):
    return spark.range(1).select(sql_or_col).collect()[0][0]


@pytest.mark.parametrize(
    "raw, ok",
    [("2026-02-26", True), ("2026-02-26 09:30:00", True), ("2026-02-26 09:30:00.123456", True), ("2026-02-26 09:30:00, 100", True),
     ("20260226", False), ("2026", False), ("2026-02-30", False), ("2026-02-26 25:00:00", False), ("'2026-02-26'", True)],
)
def test_lower_bound(spark, raw, ok):
    got = one(spark, future.lower_bound_us(F.lit(raw)))
    assert (got is not None) == ok
    if ok:
        assert got // 86_400_000_000 == 20510


def by_name(spark, name, unit, zone="+05:30", prefix="p"):
    props = F.create_map(*[F.lit(x) for x in ("dynamic_partition.enable", "1", "dynamic_partition.time_unit", unit, "dynamic_partition.prefix", prefix)])
    cols = future.window_columns(props, AS_OF, zone)
    df = spark.range(1).select(*[c.alias(n) for n, c in cols.items()])
    return df.select(future.future_by_name(F.lit(name))).collect()[0][0]


@pytest.mark.parametrize(
    "name, unit, expect",
    [("p2026022610", "HOUR", False), ("p2026022611", "HOUR", True), ("p20260226", "DAY", False), ("p20260227", "DAY", True),
     ("p202602", "MONTH", False), ("p202603", "MONTH", True), ("p2026", "YEAR", False), ("p2027", "YEAR", True),
     ("p2026_09", "WEEK", False), ("p2026_10", "WEEK", True), ("p2026_0", "WEEK", None), ("p20261301", "DAY", None),
     ("x20260101", "DAY", None), ("p2026010", "DAY", None), ("p2026010124", "HOUR", None), ("p20260101", "MINUTE", None)],
)
def test_future_by_name(spark, name, unit, expect):
    assert by_name(spark, name, unit) == expect


def test_every_known_zone_is_accepted(spark):
    zones = spark.createDataFrame([(z,) for z in future.known_zones()], "z string")
    assert zones.select(F.from_utc_timestamp(F.timestamp_micros(F.lit(0)), F.col("z")).alias("t")).where("t is not null").count() == len(future.known_zones())


def test_window_span(spark):
    def span(start, end):
        props = F.create_map(F.lit("dynamic_partition.start"), F.lit(start), F.lit("dynamic_partition.end"), F.lit(end))
        return one(spark, future.window_columns(props, AS_OF)["dyn_span"])

    assert [span("-7", "3"), span("x", "3"), span("3", "-7")] == [11, None, None]


def scored(spark, *found):
    df = spark.createDataFrame([(list(found),)], f"f array<{findings.FINDING_TYPE}>")
    return df.select(findings.score(F.col("f"))).collect()[0][0]


def f(rule, severity, confidence, **numbers):
    return (rule, severity, confidence, "", {k: float(v) for k, v in numbers.items()}, {}, "")


def test_scores(spark):
    assert scored(spark) == 0
    assert scored(spark, f("SA-E001", "warn", 0.95, totalPartitions=64, emptyRatio=0.30)) == 30
    assert scored(spark, f("SA-E001", "critical", 0.95, totalPartitions=64, emptyRatio=0.90)) == 83
    assert scored(spark, f("SA-B001", "warn", 0.85, validPartitionCount=2, anomalyCount=1)) == 18
    assert scored(spark, f("SA-B001", "warn", 0.85, validPartitionCount=64, anomalyCount=32)) == 29
    b006 = f("SA-B006", "critical", 0.95)
    assert scored(spark, b006) == 95
    assert scored(spark, b006, f("SA-E002", "warn", 0.9, emptyTailCount=10, threshold=7)) == 97
    window = {"emptyRatio": 0.7, "windowSpanWarn": 32, "windowSpanCritical": 64}
    assert scored(spark, f("SA-D004", "warn", 0.9, windowSpan=16, **window)) == 34
    assert scored(spark, f("SA-D004", "warn", 0.9, windowSpan=96, **window)) == 42


def test_scan(spark):
    names = ["a", "b", "c", "e"]
    tables = spark.createDataFrame([("d", n, "BASE TABLE", "OLAP") for n in names] + [("sys", "x", "BASE TABLE", "OLAP"), ("d", "v", "VIEW", "OLAP")],
                                   "table_schema string, table_name string, table_type string, engine string")
    counts = {"a": (20, 10), "b": (30, 25), "c": (5, 0)}
    parts = spark.createDataFrame([("d", n, f"p{i}", 0 if i < e else 7, None if i % 2 else (0 if i < e else 3)) for n, (t, e) in counts.items() for i in range(t)],
                                  "table_schema string, table_name string, partition_name string, data_length bigint, table_rows bigint")
    props = props_df(spark, {"a": {"enable": "true", "start": "-45", "end": "10"}, "b": {"enable": "TRUE", "start": "-45", "end": "10"}})
    result = scan.schema_audit_scan(tables, parts, props, AS_OF, page=9, page_size=2)
    assert (result.total_items, result.page, result.page_size, result.truncated) == (4, 2, 2, False)
    items = {r.table: r for r in scan.scan_items(scan.scan_rows(tables, parts, props), AS_OF).collect()}
    assert (items["a"].score, [s.rule_id for s in items["a"].summaries]) == (31, ["SA-E001"])
    assert items["a"].findings[0].confidence == 0.75
    assert (items["b"].score, [s.rule_id for s in items["b"].summaries]) == (75, ["SA-E001", "SA-D004"])
    inv = result.inventory.collect()[0]
    assert (inv.table_count, inv.partitioned_table_count, inv.total_partition_count, inv.empty_partition_count, inv.dynamic_partition_table_count) == (4, 3, 55, 35, 2)
    cut = scan.schema_audit_scan(tables, parts, None, AS_OF, limit=2)
    assert cut.truncated and cut.warning.startswith("Only 2 ") and not result.warning
    assert [r.table for r in cut.items.collect()] == ["b", "a"]
    assert scan.schema_audit_scan(tables, parts, props, AS_OF, table_like=" b ").total_items == 1


def test_inputs(spark):
    idx = spark.createDataFrame(
        [("d", "t", 0, "IdX", None, "b", "2"), ("d", "t", 1, "idx", "BITMAP", "a", "1"), ("d", "t", 2, "idx", "X", "a", "1"), ("d", "t", 3, "two", "", "c", None), ("d", "t", 4, "two", None, "", None)],
        "database string, table string, pos int, key_name string, index_type string, column_name string, seq_in_index string")
    got = [(r.name, r.index_type, r["columns"]) for r in inputs.index_list(idx).orderBy("pos").collect()]
    assert got == [("IdX", "BITMAP", ["a", "b"]), ("two", "", ["c"])]
    ddl = """PROPERTIES ("dynamic_partition.enable" = "false", 'Dynamic_Partition.END' = '3', "dynamic_partition.end"="4")"""
    assert one(spark, inputs.ddl_properties(F.lit(ddl))) == {"dynamic_partition.enable": "false", "dynamic_partition.end": "4"}
    assert one(spark, inputs.ddl_properties(F.lit("x"))) == {}
    assert inputs.like_pattern(" ab ") == "%ab%" and inputs.like_pattern("a_b") == "a_b" and inputs.like_pattern("") == "%"
    assert one(spark, inputs.range_lower(F.lit("[types: [DATE]; keys: ['2026-01-05', 7]; ..keys: [x])"))) == "2026-01-05"
    views = spark.createDataFrame([("d", "v", "create view v as select 1", "utf8")], "database string, table string, `Create View` string, character_set_client string")
    assert inputs.ddl_text(views).collect()[0].create_sql == "create view v as select 1"
    wide = future.window_columns(F.create_map(F.lit("dynamic_partition.start"), F.lit("-2147483648"), F.lit("dynamic_partition.end"), F.lit("3000000000")), AS_OF)
    assert one(spark, wide["dyn_span"]) == 5147483649 and one(spark, wide["dyn_end"]) == 3000000000
    cfg = rules.BucketConfig(0, -1, -1, 2.0).normalized()
    assert (cfg.min_buckets, cfg.max_buckets, cfg.tolerance) == (1, 128, 0.95)
