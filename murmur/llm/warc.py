"""Legacy ARC archives to WARC, and both formats' readers and writers.

ARC files are read by their version block: version 1 records have five header
fields, version 2 records ten; the declared length says where a record ends.
Each record becomes a WARC record with an identifier derived from its content,
an ISO time stamp, a type and SHA-1 digests.  Of records with equal payloads
the one with the largest source id stays a ``response`` (or ``resource``), the
others become ``revisit`` records that refer to it; the choice is an
aggregation over digests, so it needs no group in one task.

Archives are files of gzip members, one a record.  Spark's text writer commits
them: a member's last byte is the line separator, 0, which is the high byte of
the length of a record under 16 MiB (longer ones are followed by an empty
member, which ends in 0 too).

Defined cases: a null payload is empty; a null URL is ``urn:none``; white
space in a URL is percent-encoded; a null id has no source id and is never the
one referred to if another has one; repeated rows are records each, of which
one is the response; empty tables give archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import map_arrow, staged
from murmur.session import scratch_table_path

GZIP_LEVEL = 6
EMPTY_MEMBER_FROM = 1 << 24
SOURCE_ID = "X-Source-Id"           # carries the table's id through the formats
ARC_VERSIONS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_WHITE = re.compile(r"[\x00-\x20\x7f]")


# -- gzip members ------------------------------------------------------------------
def member(record: bytes) -> bytes:
    """One gzip member without its last byte, which is 0."""
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if len(record) >= EMPTY_MEMBER_FROM:
        e = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        out += e.flush()
    return out[:-1]


def members(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other (empty members are skipped)."""
    view, at = memoryview(content), 0
    while at < len(content):
        z, out = zlib.decompressobj(31), io.BytesIO()
        while not z.eof and at < len(content):
            piece = view[at:at + 16_384]
            out.write(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        if out.tell():
            yield out.getvalue()


def write_archive(records: DataFrame, path: str) -> None:
    """``records`` has one binary column of members as :func:`member` makes them."""
    (records.select(F.col(records.columns[0]).cast("string").alias("value"))
     .write.option("lineSep", "\x00").mode("errorifexists").text(path))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


# -- ARC ---------------------------------------------------------------------------
def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_message(payload: bytes, source_id) -> bytes:
    extra = "" if source_id is None else f"{SOURCE_ID}: {source_id}\r\n"
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{extra}"
            f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload


def arc_version_block(version: int, name: str, date14: str) -> bytes:
    body = f"{version} 0 Archive\n{ARC_VERSIONS[version]}\n\n".encode()
    tail = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date14} text/plain{tail} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, date14: str, content: bytes, name: str) -> bytes:
    url = _WHITE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    tail = "" if version == 1 else f" 200 {hashlib.md5(content).hexdigest()} - 0 {name}"
    return f"{url} 0.0.0.0 {date14} text/html{tail} {len(content)}\n".encode() + content + b"\n"


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date14: str = "20240101000000") -> None:
    """One ARC archive a task; files take turns in version 1 and 2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, name = 0, ""
        for batch in batches:
            out = []
            for pid, url, html, part in zip(*(batch.column(i) for i in range(4)), strict=True):
                if not version:
                    version, name = 1 + part.as_py() % 2, f"legacy-{part.as_py():05d}.arc.gz"
                    out.append(member(arc_version_block(version, name, date14)))
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                out.append(member(arc_record(version, url.as_py(), date14, http_message(payload, pid.as_py()), name)))
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).alias("_html"),
                        F.spark_partition_id().alias("_part"))
    write_archive(map_arrow(rows, run, "member binary"), path)


def parse_arc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields by lower-case name, content) of each record after the version block."""
    fields: list[str] = []
    for record in members(content):
        line, _, rest = record.partition(b"\n")
        values = line.decode("utf-8").split(" ")
        body = rest[:int(values[-1])]
        if line.startswith(b"filedesc://"):
            version, names = body.split(b"\n")[:2]
            if int(version.split(b" ")[0]) not in ARC_VERSIONS:
                raise ValueError(f"unknown ARC version line {version!r}")
            fields = names.decode().lower().split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in an ARC header of {len(fields)}: {line[:200]!r}")
        yield dict(zip(fields, values, strict=True)), body


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the empty line, payload); no headers if it isn't an HTTP message."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[:end + 4], content[end + 4:])


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return found and found[1].decode("utf-8")


# -- WARC --------------------------------------------------------------------------
def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def record_id(fields: dict, digest: str, source_id: str | None) -> str:
    name = "|".join([fields["url"], fields["archive-date"], digest, source_id or ""])
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_time(date14: str) -> str:
    d = date14.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers by lower-case name, block) of each record."""
    for record in members(content):
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield headers, rest[:int(headers["content-length"])]


def _arc_keys(archives: DataFrame) -> DataFrame:
    """(digest, payload_bytes, source, place) per ARC record: all that the choice of originals needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for k, (_, body) in enumerate(parse_arc(content.as_py())):
                    head, payload = split_http(body)
                    sid = header_value(head, SOURCE_ID)
                    rows.append((sha1_base32(payload), len(payload), sid and int(sid), f"{path.as_py()}#{k:09d}"))
                if rows:
                    d, n, s, p = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(n, pa.int64()), pa.array(s, pa.int64()),
                                                      pa.array(p)], ["digest", "bytes", "source", "place"])

    return map_arrow(archives, run, "digest string, bytes long, source long, place string")


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0) -> None:
    """Convert the ARC archives under ``arc_path`` to WARC archives under ``warc_path``."""
    keys = staged(_arc_keys(read_archive(spark, arc_path)), "arc-keys")
    originals = (keys.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes")
                 .agg(F.max(F.struct("source", "place")).alias("original"), F.count(F.lit(1)).alias("n"))
                 .filter("n > 1").select("digest", "bytes", "original"))
    revisits = keys.join(originals, ["digest", "bytes"]).filter(F.col("place") != F.col("original.place")).select(
        "place", F.col("original.source").alias("to_source"), F.col("original.place").alias("to_place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                places, blocks = [], []
                for k, (fields, body) in enumerate(parse_arc(content.as_py())):
                    head, payload = split_http(body)
                    sid, digest = header_value(head, SOURCE_ID), sha1_base32(payload)
                    kind = "response" if head else "resource"
                    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(fields, digest, sid)),
                               ("WARC-Date", warc_time(fields["archive-date"])), ("WARC-Target-URI", fields["url"]),
                               ("WARC-IP-Address", fields["ip-address"]),
                               ("WARC-Payload-Digest", f"sha1:{digest}"),
                               ("Content-Type", "application/http; msgtype=response" if head else fields["content-type"])]
                    places.append(f"{path.as_py()}#{k:09d}")
                    blocks.append(member(warc_record([*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(body)}")], body)))
                    if len(places) >= 256:
                        yield _packed(places, blocks)
                        places, blocks = [], []
                if places:
                    yield _packed(places, blocks)

    converted = map_arrow(read_archive(spark, arc_path), run, "place string, member binary")
    chosen = converted.join(revisits, "place", "left")
    write_archive(map_arrow(chosen.select("member", "to_source", "to_place"), _as_revisits, "member binary"), warc_path)


def _packed(places: list, blocks: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(places), pa.array(blocks, pa.binary())], ["place", "member"])


def _as_revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of records that repeat another's payload, cut down to revisit records."""
    first = True
    for batch in batches:
        out = []
        if first:
            info = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
            out.append(member(warc_record([("WARC-Type", "warcinfo"),
                                           ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                           ("WARC-Date", "2024-01-01T00:00:00Z"),
                                           ("Content-Type", "application/warc-fields")], info)))
            first = False
        for whole, to_source, to_place in zip(*(batch.column(i) for i in range(3)), strict=True):
            if to_place.as_py() is None:
                out.append(whole.as_py())
                continue
            headers, block = next(parse_warc(whole.as_py() + b"\x00"))
            head, payload = split_http(block)
            kept = [("WARC-Type", "revisit"), ("WARC-Record-ID", headers["warc-record-id"]),
                    ("WARC-Date", headers["warc-date"]), ("WARC-Target-URI", headers["warc-target-uri"]),
                    ("WARC-Payload-Digest", headers["warc-payload-digest"]),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("X-Payload-Length", str(len(payload))), ("Content-Type", headers["content-type"])]
            if to_source.as_py() is not None:
                kept.append(("X-Refers-To-Source-Id", str(to_source.as_py())))
            out.append(member(warc_record([*kept, ("WARC-Block-Digest", f"sha1:{sha1_base32(head)}")], head)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, url, date, source_id, payload_bytes, payload_digest, refers_to) per captured record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "url", "date", "source_id", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    if h["warc-type"] not in ("response", "resource", "revisit"):
                        continue
                    if h.get("warc-block-digest") != f"sha1:{sha1_base32(block)}":
                        raise ValueError(f"block digest of {h['warc-record-id']} does not match")
                    head, payload = split_http(block)
                    sid, to = header_value(head, SOURCE_ID), h.get("x-refers-to-source-id")
                    size = int(h["x-payload-length"]) if h["warc-type"] == "revisit" else len(payload)
                    rows.append((h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"],
                                 sid and int(sid), size, h["warc-payload-digest"].removeprefix("sha1:"), to and int(to)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return map_arrow(read_archive(spark, path), run, "record_id string, record_type string, url string, date string, "
                     "source_id long, payload_bytes long, payload_digest string, refers_to long")


def pages_to_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages as ARC archives, those converted to WARC, and the WARC records read back."""
    spark = pages.sparkSession
    base = scratch_table_path(spark, f"archives-{uuid.uuid4().hex}")
    write_arc(pages, f"{base}/arc", id_col, url_col, html_col)
    convert_arc(spark, f"{base}/arc", f"{base}/warc")
    return read_warc(spark, f"{base}/warc")
