"""Conversion of legacy ARC archives to WARC.

An ARC file begins with a version block whose second line names the version; each record is one
header line (5 fields in version 1, 10 in version 2, the declared length last) and as many bytes as
declared. The converter synthesises what ARC lacks: record ids (from archive name and offset), ISO
timestamps, record types, payload and block digests, and revisit records for payloads seen before.

Archives are written by Spark's text sink (one record a value) and read as whole files, streamed
through the parser record by record: a gzip file cannot be split, so an archive belongs to one task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import salted_join, scratch_dir, table

#: Fields of a header line by version of the archive.
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"],
}
#: The definitions of these lines inside the version block.
ARC_LINES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
BATCH_BYTES = 8 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size; ``sized`` is the place of the large column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized] or b"") + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


# ---------------------------------------------------------------- writing ARC


def http_head(key: int | None, size: int) -> bytes:
    named = f"X-Page-Id: {key}\r\n" if key is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {size}\r\n\r\n".encode()


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 local\n{ARC_LINES[version]}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "content_type": "text/plain", "result_code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name}
    return header_line(version, fields, len(body)) + body


def header_line(version: int, fields: dict[str, str], length: int) -> bytes:
    return (" ".join(str(length) if f == "length" else fields[f] for f in ARC_FIELDS[version]) + "\n").encode()


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000", version: int | None = None) -> None:
    """One archive per partition of (page_id, url, html); without ``version`` both versions take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        form, name = version or 1 + part % 2, f"part-{part}.arc"

        def records():
            block = version_block(form, name, date)
            offset = len(block) + 1
            yield (block,)
            for batch in batches:
                for key, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    payload = (html or "").encode()
                    doc = http_head(key, len(payload)) + payload
                    fields = {"url": quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]"), "ip": "0.0.0.0", "date": date, "content_type": "text/html", "result_code": "200", "checksum": "-", "location": "-", "offset": str(offset), "filename": name}
                    record = header_line(form, fields, len(doc)) + doc
                    offset += len(record) + 1
                    yield (record,)

        yield from batches_of(records(), pa.schema([("value", pa.binary())]), 0)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.options(lineSep="\n", **GZIP).text(folder)


# ---------------------------------------------------------------- reading archives


def opened(content: bytes) -> io.BufferedIOBase:
    """Plain or gzip, one member or one per record."""
    plain = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 16) if content[:2] == b"\x1f\x8b" else plain


def arc_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes, str | None]]:
    """(offset, version, fields, block, fault) of every record but the version blocks.

    A block shorter than declared is returned with a fault; after a header line that is no header
    line, or an unknown version, nothing in the file can be placed, so one fault ends it, as one does
    where a gzip file is cut short or broken.
    """
    source, version, place, broken = opened(content), 1, 0, False

    def read(size: int | None = None) -> bytes:
        """A line, or a block; a gzip file that is cut short or broken ends there."""
        nonlocal broken
        found = b""
        try:
            if size is None:
                return source.readline()
            while len(found) < size and (more := source.read(min(size - len(found), 1 << 24))):
                found += more
        except (EOFError, OSError, zlib.error):
            broken = True
        return found

    while line := read():
        offset, place = place, place + len(line)
        if not line.strip():
            continue
        names = ARC_FIELDS[version]
        if line.startswith(b"filedesc://"):
            values = line.split()
            names = ARC_FIELDS[2 if len(values) == len(ARC_FIELDS[2]) else 1]
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not re.fullmatch("[0-9]{1,18}", values[-1]):
            yield offset, version, {}, b"", "no header line"
            return
        length = int(values[-1])
        block = read(length)
        place += len(block)
        if line.startswith(b"filedesc://"):
            first = block.split(None, 1)
            if not first or first[0] not in (b"1", b"2"):
                yield offset, 0, {}, b"", "unknown version"
                return
            version = int(first[0])
            continue
        yield offset, version, dict(zip(names, values)), block, None if len(block) == length else "truncated"
    if broken:
        yield place, version, {}, b"", "broken archive"


def head_and_payload(block: bytes) -> tuple[bytes, bytes]:
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def field(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def number(text: str | None) -> int | None:
    """A whole number that 64 bits hold, or None."""
    value = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def iso_time(date: str) -> str:
    """14 digits as WARC time; shorter dates of early archives are filled up, others are the epoch."""
    if not re.fullmatch("[0-9]{8,14}", date):
        return "1970-01-01T00:00:00Z"
    d = date + "000000"[len(date) - 8 :] if len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


READ = "archive string, place long, version int, url string, ip string, time string, content_type string, type string, page_id long, record_id string, payload_bytes long, payload_digest string, block_digest string, head_digest string, head binary, fault string, block binary"
READ_TYPES = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in READ.split(", "))]
)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def read_arc(spark: SparkSession, folder: str, blocks: bool = True) -> DataFrame:
    """One row a record of all archives in the folder, with what WARC needs; ``blocks=False`` leaves the blocks out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    name = path.rpartition("/")[2]
                    for place, version, f, block, fault in arc_records(content.as_py()):
                        head, payload = head_and_payload(block)
                        kind = "response" if head else "resource"
                        made = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{place}"))
                        yield (
                            name, place, version, f.get("url"), f.get("ip"), iso_time(f.get("date", "")), f.get("content_type"), kind, number(field(head, b"x-page-id")),
                            made, len(payload), digest(payload), digest(block), digest(head), head, fault, block if blocks else None,
                        )

        yield from batches_of(rows(), READ_TYPES, -1)

    return files(spark, folder).mapInArrow(run, READ)


# ---------------------------------------------------------------- WARC


def lines(*parts: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in parts))


def warc_records(records: DataFrame, least: int = 0, narrow: DataFrame | None = None) -> DataFrame:
    """Parsed ARC records with their WARC type and, for groups of equal payloads, their first record.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page id
    stays as it is (records without one come last; ties go to the smaller record id); the others
    become revisits that refer to it. ``narrow`` may give the same records without blocks.
    """
    best = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first")
    seen = (narrow or records).where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(best, F.count(F.lit(1)).alias("n"))
    firsts = seen.where("n > 1").select("payload_digest", "first")
    marked = salted_join(records, firsts, "payload_digest", F.col("record_id"))
    return marked.withColumn("type", F.when((F.col("payload_bytes") >= least) & (F.col("first.record_id") != F.col("record_id")), F.lit("revisit")).otherwise(F.col("type")))


def write_warc(records: DataFrame, folder: str) -> None:
    again = F.col("type") == "revisit"
    block = F.when(again, F.col("head")).otherwise(F.col("block")).cast("string")
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), c, F.lit(">"))
    head = lines(
        ("WARC-Type", F.col("type")),
        ("WARC-Record-ID", urn(F.col("record_id"))),
        ("WARC-Date", F.col("time")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-IP-Address", F.col("ip")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(again, F.col("head_digest")).otherwise(F.col("block_digest")))),
        ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(again, urn(F.col("first.record_id")))),
        ("X-Refers-To-Page-Id", F.when(again, F.col("first.page_id").cast("string"))),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")),
        ("WARC-Truncated", F.when(F.col("fault") == "truncated", F.lit("length"))),
        ("Content-Type", F.when(F.length("head") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("content_type"))),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    records.select(F.concat(F.lit("WARC/1.0\r\n"), head, F.lit("\r\n"), block).alias("value")).write.options(lineSep="\r\n\r\n", **GZIP).text(folder)


def warc_parts(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record."""
    source = opened(content)
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("not a WARC record")
            continue
        headers: dict[str, str] = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, source.read(int(headers["content-length"]))


BACK = "page_id long, url string, type string, record_id string, refers_to_record string, refers_to long, time string, payload_bytes long, payload_digest string, payload binary"
BACK_TYPES = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in BACK.split(", "))])


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row a record; length and digest of stored payloads are worked out anew, those of revisits come from the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column("content"):
                    for h, block in warc_parts(content.as_py()):
                        head, payload = head_and_payload(block)
                        again = h["warc-type"] == "revisit"
                        size, told = (number(h.get("x-payload-length")), h["warc-payload-digest"].removeprefix("sha1:")) if again else (len(payload), digest(payload))
                        yield (
                            number(field(head, b"x-page-id")), h.get("warc-target-uri"), h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), number(h.get("x-refers-to-page-id")),
                            h["warc-date"], size, told, payload if payloads and not again else None,
                        )

        yield from batches_of(rows(), BACK_TYPES, -1)

    return files(spark, folder).mapInArrow(run, BACK)


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = 0) -> None:
    """All ARC files of a folder as WARC files in another; records that cannot be placed (see ``arc_records``) are left out."""
    records, narrow = (read_arc(spark, arc_folder, blocks).where("fault IS NULL OR fault = 'truncated'") for blocks in (True, False))
    write_warc(warc_records(records, least, narrow), warc_folder)


def pages_through_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html) rows written as ARC, converted to WARC and read back.

    A null html is an empty payload (and empty payloads equal each other), a null url is about:blank, a
    null page_id comes back as null. Repeated rows are records of their own: one is the response. An
    empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = scratch_dir(spark, "op6-arc"), scratch_dir(spark, "op6-warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    return read_warc(spark, warc, payloads=False).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_through_archives(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
bits AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, x, array_to_string(list_transform(range(1, 41), lambda i:
           substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(x, i, 1)) - 1) + 1, 4)), '') AS b FROM p),
marked AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first, row_number() OVER (PARTITION BY x ORDER BY page_id) AS n FROM bits)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN first END AS refers_to
FROM marked
"""
