import pytest
from pyspark.sql import functions as F

from querylens.functions import coerce, display, encode, sqltext


def apply(spark, fn, inputs, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {type_}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_event_time(spark):
    got = apply(
        spark,
        lambda c: coerce.event_time_ms(c, "Asia/Shanghai"),
        ["2025-12-25 11:17:02,188", "2025-13-32 25:61:02.1881+0530", "2025-12-25 11:17:02Z", "2025-12-25", None],
    )
    assert got[0] == 1766632622188  # 03:17:02.188 UTC
    # month 13, day 32 and hour 25 roll over: 2026-02-02 02:01:02.188 at +05:30
    assert got[1] == 1769977862188
    assert got[2] == 1766661422000
    assert got[3:] == [None, None]


def test_client_address(spark):
    got = apply(spark, coerce.client_address, ["203.0.113.10:51178", "::1", ":5", " h ", "", None])
    assert got == ["203.0.113.10", ":", ":5", "h", None, None]


def test_prefix_int_and_bool(spark):
    assert apply(spark, coerce.prefix_int, ["13ms", " -7", "x1", "", None, "99999999999999999999"]) == [
        13, -7, None, None, None, None,
    ]
    assert apply(spark, coerce.loose_bool, [" TRUE ", "n", "maybe", "", None]) == [True, False, None, None, None]


def test_catalogue_numbers(spark):
    inputs = ["12.5 GB", "3MiB", "1,024", "-3 KB", "5 XB", "", None, "9999999999 PB", "7.9"]
    assert apply(spark, coerce.byte_size, inputs) == [
        13421772800, 3145728, 1024, 0, None, None, None, 9223372036854775807, 7,
    ]
    assert apply(spark, coerce.loose_unsigned, ["1,024", "7.9", "-3", "", "x", None]) == [1024, 7, 0, None, None, None]
    assert apply(spark, coerce.number_like, ["149,996,355", "1_000", "x", "", "1e3"]) == [
        149996355.0, 1000.0, None, None, 1000.0,
    ]


def test_template(spark):
    got = apply(
        spark,
        sqltext.template_of,
        [
            "select * from t where a = 10 and b = 'x' and is_deleted = 0",
            "select 1.5x, 'a''b', 'open from t1 where x not  in (1, f(2)) and y in(3)",
            "  ",
            "select -1, 1e5, 0x1F, t1.c2\r\n\tfrom x and tenant_id = 'z'",
            "select 1; select 2",
        ],
    )
    assert got == [
        "select * from t where a = ? and b = ?",
        "select ?.5x, ?, 'open from t1 where x NOT IN (?) and y IN (?)",
        "",
        "select -?, 1e5, 0x1F, t1.c2 from x",
        "select ?; select ?",
    ]


def test_template_survives_long_statements(spark):
    long_strings = "select " + "'a''b'," * 30000 + " 1 from t"
    long_list = "select 1 from t where k in (" + "(1),(2)," * 30000 + "3)"
    got = apply(spark, sqltext.template_of, [long_strings, long_list])
    assert got[0].endswith("?, ? from t")
    assert got[1] == "select ? from t where k IN (?)"


def test_rules_with_flags(spark):
    rules = [
        sqltext.StrippingRule("upper", r"\s+AND\s+shard\s*=\s*\?", flags=""),
        sqltext.StrippingRule("group", r"from\s+([a-z]+)_[0-9]+", "from $1"),
        sqltext.StrippingRule("end", r";$", flags="m"),
    ]
    texts = ["select a FROM orders_7 where x = ? AND shard = ? and shard = ? AND shard = ?", "b;", "plain", None]
    assert apply(spark, lambda c: sqltext.strip_template(c, rules), texts) == ["select a from orders where x = ? and shard = ?", "b", "plain", None]
    assert apply(spark, lambda c: sqltext.applied_rules(c, rules), texts[:3]) == [["upper", "group"], ["end"], []]
    with pytest.raises(ValueError):
        sqltext.StrippingRule("wrong", "a", flags="g")


def test_applied_rules(spark):
    got = apply(
        spark,
        sqltext.applied_rules,
        ["a and is_deleted = ? AND tenant_id=?", "a and tenant_id = ?", "plain"],
    )
    assert got == [["strip_soft_delete_flag", "strip_tenant_id"], ["strip_tenant_id"], []]


def test_table_guess(spark):
    got = apply(
        spark,
        lambda c: sqltext.table_guess(c, F.lit("d")),
        [
            "select * from `db1`.`tbl1` where k = 1",
            "with a as (select 1 from `db1` . `t1`) select * from a",
            "with a as (select 2) select * from a, (select 1 from t9) b",
            "insert into t values (1)",
            "select * from test_table",
        ],
    )
    assert got == ["db1.tbl1", "db1.t1", "d.t9", None, "d.test_table"]


def test_first_json_string(spark):
    got = apply(spark, sqltext.first_json_string, ['["a","b"]', '[1," ","x"]', "{", '{"a":1}', "[]", None, ""])
    assert got == ["a", "x", None, None, None, None, None]


def test_table_name_parts(spark):
    df = spark.createDataFrame([("c.d.t",), ("t",), (".",)], "g string")
    db, table = sqltext.table_name_parts(F.col("g"))
    assert [tuple(r) for r in df.select(db, table).collect()] == [("d", "t"), ("", "t"), ("", ".")]


def test_split_quoted(spark):
    got = apply(
        spark, lambda c: encode.split_quoted(c, ","), ['a,"b,c",d', 'a,"b""c",d', '"open,a', 'a,,"x"y,', "", ',"",']
    )
    assert got == [["a", "b,c", "d"], ["a", 'b"c', "d"], None, ["a", "", "xy", ""], [""], ["", "", ""]]
    assert apply(spark, lambda c: encode.split_quoted(c, "\t"), ['a\t"b\tc"\td']) == [["a", "b\tc", "d"]]


def test_escapes(spark):
    assert apply(spark, encode.unescape_export, [r"hello\nworld", r"a\tb", r"a\rb", r"a\\b", r"a\xb", r"a\\nb"]) == [
        "hello\nworld", "a\tb", "a\rb", "a\\b", r"a\xb", r"a\nb",
    ]
    assert apply(spark, encode.decode_dump_string, [r"a\nb\\n\'x''\q\Z\"", "select\\n\\t\\\\path"]) == [
        "a\nb\\n'x'q\x1a\"", "select\n\t\\path",
    ]
    assert apply(spark, encode.tsv_field, ["a\\b\n\r\t", "", None]) == [r"a\\b\n\r\t", "", r"\N"]
    assert apply(spark, encode.export_text, [" x ", r"\N", "NULL", "", None, r"a\tb"]) == [
        "x", None, None, None, None, "a\tb",
    ]


def test_display(spark):
    assert apply(spark, display.duration_label, [500, 59999, 120000, 7200000, None], "long") == [
        "500 ms", "60.00 s", "2.00 min", "2.00 h", "-",
    ]
    assert apply(spark, display.bytes_label, [500, 1536, 3 * 1024**2, 2 * 1024**5, None], "long") == [
        "500.0 B", "1.5 KB", "3.0 MB", "2048.0 TB", "-",
    ]
    assert apply(spark, display.percent_label, [0.12345, None], "double") == ["12.35%", "-"]
    assert apply(spark, display.bucket_width_label, [300, 3600, 172800, 45], "long") == ["5m", "1h", "2d", "45s"]
    assert apply(spark, lambda c: display.middle_cut(c, 10), ["abcdefghijkl", "short"]) == ["abc...ijkl", "short"]
