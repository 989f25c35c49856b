import gzip
import hashlib
import base64

import duckdb
import pytest

from llm import arc_convert as A


def base32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_versions_and_faults():
    v1 = A.version_block(1, "a.arc", "19960101000000") + b"\n" + b"http://a/b c 1.2.3.4 19970203040506 text/html 5\nHello\n" + b"dns:x 1.1.1.1 1997020304 text/dns 3\nabc\n"
    rows = list(A.arc_records(v1))
    assert [(r[1], r[2]["url"], r[3], r[4]) for r in rows] == [(1, "http://a/b c", b"Hello", None), (1, "dns:x", b"abc", None)]
    assert v1[rows[0][0] :].startswith(b"http://a/b c")
    v2 = A.version_block(2, "b.arc", "20010101000000") + b"\nhttp://q/ 1.2.3.4 20010101000000 text/html 404 - - 99 b.arc 4\n\n\n\n\n\nhttp://r/ 1.2.3.4 20010101000000 text/html 200 - - 99 b.arc 10\nshort"
    members = gzip.compress(v2[:150]) + gzip.compress(v2[150:])
    assert [(r[1], r[2]["result_code"], r[3], r[4]) for r in A.arc_records(members)] == [(2, "404", b"\n\n\n\n", None), (2, "200", b"short", "truncated")]
    assert [r[4] for r in A.arc_records(b"filedesc://x 0 0 text/plain 2\n7 \nhttp")] == ["unknown version"]
    assert [r[4] for r in A.arc_records(v1 + b"garbage line\nmore")] == [None, None, "no header line"]
    assert list(A.arc_records(b"")) == []
    assert [r[4] for r in A.arc_records(gzip.compress(v1)[:-20])][-1] == "broken archive"
    assert [r[4] for r in A.arc_records(v1 + "http://x/ 1.1.1.1 19970203040506 text/html ٣\nabc".encode())][-1] == "no header line"
    assert [r[4] for r in A.arc_records(v1 + b"http://x/ 1.1.1.1 19970203040506 text/html 999999999999999999\nabc")][-1] == "truncated"
    assert A.iso_time("1997020304") == "1997-02-03T04:00:00Z" and A.iso_time("x") == "1970-01-01T00:00:00Z"


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "same\r\n\r\nWARC/1.0\r\n"), (2, None, "same\r\n\r\nWARC/1.0\r\n"), (2, "http://b", None), (3, "http://c", ""), (4, "http://é", "é" * 100_000), (None, "http://d", "same\r\n\r\nWARC/1.0\r\n"), (9, "u", "once"), (9, "u", "once"), (None, "n", "no id")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    out = sorted((tuple(r) for r in A.pages_through_archives(df).collect()), key=str)
    expect, first = [], {}
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        text = html or ""
        again = text in first
        expect.append((key, len(text.encode()), base32(text), "revisit" if again else "response", first[text] if again else None))
        first.setdefault(text, key)
    assert out == sorted(expect, key=str)
    A.write_arc(df, str(tmp_path / "arc"), version=2)
    A.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), least=5)
    back = A.read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(back) == len(rows) and sum(r.type == "revisit" for r in back) == 2
    assert sorted(bytes(r.payload).decode() for r in back if r.type == "response") == sorted(["same\r\n\r\nWARC/1.0\r\n", "", "", "é" * 100_000, "once", "once", "no id"])
    ids = {r.record_id for r in back}
    assert len(ids) == len(rows) and all(r.refers_to_record in ids for r in back if r.type == "revisit")


def test_long_ids(spark):
    keys = [1234567890123456789, -(1 << 63), (1 << 63) - 1, -123456789012345678, 0]
    df = spark.createDataFrame([(k, "http://a", f"page {k}") for k in keys] + [(k + 1, "http://b", f"page {k}") for k in keys[:2]], "page_id long, url string, html string")
    out = {r.page_id: (r.record_type, r.refers_to) for r in A.pages_through_archives(df).collect()}
    assert out == {k: ("response", None) for k in keys} | {k + 1: ("revisit", k) for k in keys[:2]}
    assert [A.number(x) for x in (None, "", "-", "1.5", "٣", "9223372036854775808", "-9223372036854775809", "12345678901234567890")] == [None] * 8


def test_empty(spark):
    assert A.pages_through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert sorted(tuple(r) for r in A.op6(spark, sf_dir).collect()) == sorted(con.execute(A.OP6_SQL).fetchall())
