r"""Legacy archive converter: ARC records of either version become WARC records.

A version-specific header line gives the address, date, type and declared length of an ARC record; from those
come the WARC identifier, timestamp, type and digests.  Archives are written by Spark's text writer, whose line
separator is the end of a WARC record, so they go to any file system with Spark's commit protocol, and are read
back by their declared lengths alone.

Records with equal payloads of at least MIN_REVISIT bytes: the largest id is the response, the others revisit it.

Edge cases: null html is an empty payload, a null url the address "-"; blanks in addresses are percent-encoded;
rows that tie on the largest id are all responses; a null id is never the largest while another is there;
payloads may hold header lines or separators, as only lengths are trusted; very large payloads get files of their own;
an empty table gives no records; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, new_path

MIN_REVISIT = 1000
#: Bytes of a payload up to which so many records share an archive file; a reader holds one file at a time.
FILE_RECORDS = ((64_000, 1000), (1_000_000, 64), (1 << 40, 1))
#: Tasks that the copies of one payload are dealt out to.
SALTS = 16
#: The fields of a header line, by ARC version.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    block: bytes


def arc_record(url: str, html: bytes, version: int, date: str = "20240101000000", ip: str = "0.0.0.0") -> bytes:
    """One ARC record: header line, HTTP head and payload, a line end."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}{END}".encode()
    block = head + html
    told = {"url": url, "ip": ip, "date": date, "type": "text/html", "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": "-", "length": str(len(block))}
    return " ".join(told[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_arc(archive: bytes, version: int | None = None) -> Iterator[ArcRecord]:
    """Records of an ARC archive; a version block at its start names the version, the argument does where there is none."""
    at = 0
    while at < len(archive):
        if archive[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = archive.index(b"\n", at)
        parts = archive[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(parts[-1])
        block = archive[end + 1 : end + 1 + length]
        at = end + 1 + length
        if parts[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
            continue
        if len(block) < length:
            raise ValueError(f"{parts[0]}: {length} bytes are declared, {len(block)} are there")
        names = FIELDS.get(version) or next((f for f in FIELDS.values() if len(f) == len(parts)), None)
        if names is None or len(parts) != len(names):
            raise ValueError(f"{parts[0]}: {len(parts)} fields don't fit version {version}")
        told = dict(zip(names, parts))
        yield ArcRecord(told["url"], told["ip"], told["date"], told["type"], block)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """Legacy dates have 8 to 14 digits; what is missing is the start of the period."""
    d = (date + "00000000000000")[:14] if len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, key: str, refers_to: str | None = None) -> bytes:
    """The WARC record, without the blank lines that end it.  refers_to: the key of the response with this payload."""
    head, _, payload = record.block.partition(END.encode())
    block = head + END.encode() + (b"" if refers_to is not None else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {iso_date(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: {sha1_base32(payload)}",
        f"WARC-Block-Digest: {sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Source-Key: {key}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Key: {refers_to}"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + END).encode() + block


def parse_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(END.encode(), at)
        first, *lines = archive[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        begin = end + 4
        stop = begin + int(headers["content-length"])
        if archive[stop : stop + 4] != END.encode():
            raise ValueError(f"the record at byte {at} doesn't end where it declares")
        yield headers, archive[begin:stop]
        at = stop + 4


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id") -> None:
    """ARC records of pages(page_id, url, html), converted, as WARC files in path."""
    arrow_limits(pages.sparkSession)
    rows = pages.select(pages[id_column].cast("bigint").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("-")).alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html")
    many = rows.select("page_id", F.sha1("html").alias("sha"), size.alias("size")).where(F.col("size") >= MIN_REVISIT).groupBy("sha", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    # small payloads meet nothing and are dealt out by row, large ones by payload and salt, so no payload's copies share one task
    many = many.select("sha", "size", "response", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    at = F.xxhash64("page_id", "url")
    told = rows.select("*", F.when(size >= MIN_REVISIT, F.sha1("html")).otherwise(F.hex(at)).alias("sha"), size.alias("size"), F.pmod(at, F.lit(SALTS)).alias("salt"))
    told = told.join(many, ["sha", "size", "salt"], "left")
    revisits = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    told = told.select("page_id", "url", "html", "size", F.when(revisits, F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, html, _, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                address = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
                legacy = arc_record(address or "-", html.encode(), 1 + (page_id or 0) % 2)
                key = "-" if page_id is None else str(page_id)
                out += [to_warc(r, key, None if refers_to is None else str(refers_to)).decode() for r in parse_arc(legacy)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    largest = rows.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low = -1
    for high, records in FILE_RECORDS:
        if low < largest:  # a file holds so many records that its payloads stay within a bound
            part = told.where((F.col("size") > low) & (F.col("size") <= high))
            part.mapInArrow(run, "value string").write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        low = high


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, date of each record in the archives."""
    arrow_limits(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in parse_warc(gzip.decompress(content.as_py())):
                    head, _, payload = block.partition(END.encode())
                    size = int(next(x for x in head.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                    if headers["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != headers["warc-payload-digest"]):
                        raise ValueError(f"{headers['warc-record-id']}: the payload isn't what its headers declare")
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    key = headers["warc-source-key"]
                    refers = headers.get("warc-refers-to-key")
                    rows.append((None if key == "-" else int(key), size, digest, headers["warc-type"], None if refers is None else int(refers), headers["warc-target-uri"], headers["warc-date"]))
                columns = list(zip(*rows)) if rows else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, date string")


def archived(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
