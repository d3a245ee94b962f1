"""Converts legacy ARC archives into WARC, writes WARC archives of pages with revisit records, and reads them back.

ARC: the opening filedesc record names the version; version 1 header lines have five fields (URL, IP address, date, type,
length), version 2 lines ten (result code, checksum, location, offset and file name besides). The declared length alone says
where a record ends. The WARC equivalent gets a record id derived from URL, date and payload, an ISO timestamp, the
declared type, and block and payload digests.

Records with equal payloads of at least REVISIT_BYTES bytes: that of the largest page_id is the response, the others revisit it.

Defined cases: null html is an empty payload; a null url becomes urn:page:<page_id>; rows that repeat the response's page_id
and payload are responses too, with one record id, as their records are the same; a null page_id sorts below all others; an empty table gives no archives and no rows; other columns are
not looked at. Archives are named anew in every attempt and known through a manifest, so lost executors leave no half-read file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, filesystem, lookup, materialize, partitions, prepare, read_table, scratch_path, slices
from .ordering import real_id

REVISIT_BYTES = 1000
#: An archive is closed behind the record that takes it over so many bytes before compression.
ARCHIVE_BYTES = 1 << 30
FETCHED = "20240101000000"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(r"[\x00-\x20\x7f]")


# --- ARC


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    code: str
    body: bytes


class ArcError(ValueError):
    pass


_FIELDS = {"1": 5, "2": 10}


def arc_opening(version: str, name: str = "pages.arc", date: str = FETCHED) -> bytes:
    fields = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 quillspan\n{fields[version]}\n".encode()
    rest = "" if version == "1" else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: str, url: str, body: bytes, kind: str = "text/html", ip: str = "0.0.0.0", date: str = FETCHED, code: str = "200", name: str = "pages.arc", offset: int = 0) -> bytes:
    url = _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    rest = "" if version == "1" else f" {code} - - {offset} {name}"
    return f"{url} {ip} {date} {kind}{rest} {len(body)}\n".encode() + body + b"\n"


def arc_records(stream):
    """The records behind the opening one of an ARC archive (a binary stream), in order."""
    head = stream.readline()
    parts = head.decode("utf-8", "surrogateescape").split(" ")
    if not head.startswith(b"filedesc://") or not parts[-1].strip().isdigit():
        raise ArcError("no filedesc record")
    opening = stream.read(int(parts[-1]))
    version = opening.split(b" ", 1)[0].decode()
    if version not in _FIELDS:
        raise ArcError(f"unknown version {version!r}")
    n = _FIELDS[version]
    while line := stream.readline():
        if not line.strip():
            continue
        f = line.decode("utf-8", "surrogateescape").rstrip("\r\n").rsplit(" ", n - 1)
        if len(f) != n or not f[-1].isdigit():
            raise ArcError(f"bad header line {line[:200]!r}")
        body = stream.read(int(f[-1]))
        if len(body) != int(f[-1]):
            raise ArcError("the archive ends within a record")
        yield ArcRecord(f[0], f[1], f[2], f[3], f[4] if n == 10 else "", body)


# --- WARC


def record_id(url: str, date: str, digest: str, key: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def iso_date(date: str) -> str:
    d = (date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; bodies without a status line are all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def warc_from_arc(r: ArcRecord, key: str = "", refers_to: str | None = None, more: dict[str, str] | None = None) -> bytes:
    """The equivalent WARC record; with refers_to (a record id) a revisit without the payload."""
    head, payload = split_http(r.body)
    sha1 = hashlib.sha1(payload).hexdigest()
    block = r.body if refers_to is None else head
    kind = ("revisit" if refers_to else "response") if head else "resource"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(r.url, r.date, sha1, key),
        "WARC-Date": iso_date(r.date),
        "WARC-Target-URI": r.url,
        "WARC-IP-Address": r.ip,
        "WARC-Payload-Digest": _digest(payload),
        "WARC-Block-Digest": _digest(block),
        **({"WARC-Refers-To": refers_to, "WARC-Profile": PROFILE} if refers_to else {}),
        "Content-Type": "application/http; msgtype=response" if head else r.kind,
        **(more or {}),
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def warc_members(stream, chunk: int = 1 << 20):
    """The decompressed records of a .warc.gz stream, one gzip member each."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            if parts and not z.eof:
                raise ValueError("the archive ends within a record")
            return
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    at = record.index(b"\r\n\r\n")
    lines = record[:at].decode("utf-8", "surrogateescape").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, record[at + 4 : at + 4 + int(fields["Content-Length"])]


def bare_digest(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


# --- tables


def _roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html and first, the page_id and url whose record is the response (null: this one is).

    Only pages that may be revisits meet their copies; digests of very many copies do so by a bounded broadcast."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    low = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = pages.select(low.alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1(F.col("html").cast("binary"))))
    last = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n")).where("n > 1")
    placed = lookup(rows, materialize(last, "copies"), ["digest"], "n", pages.count(), "page_id", "left")
    return placed.select("page_id", "url", "html", F.when(F.col("last.page_id") != F.col("page_id"), F.col("last")).alias("first"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages, by way of ARC records, into .warc.gz archives in folder. Returns the manifest: file, records."""
    prepare(pages.sparkSession)
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)

    def run(batches):
        out, name, size, records = None, None, 0, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])
        for n, whole in enumerate(batches):
            for batch in slices(whole, "html"):
                version = "12"[n % 2]
                ids, urls, htmls, firsts = (column(batch, c).to_pylist() for c in ("page_id", "url", "html", "first"))
                address = lambda i, url: url if url else f"urn:page:{i}"
                bodies = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + h.encode() for h in htmls]
                arc = io.BytesIO(arc_opening(version) + b"".join(arc_record(version, address(i, u), b) for i, u, b in zip(ids, urls, bodies)))
                for r, i, first in zip(arc_records(arc), ids, firsts):
                    if out is None:
                        name, size, records = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                        own, path = filesystem(name)
                        out = own.open_output_stream(path, compression=None)
                    payload = split_http(r.body)[1]
                    refers = None
                    if first is not None:
                        url = _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", address(first["page_id"], first["url"]))
                        refers = record_id(url, r.date, hashlib.sha1(payload).hexdigest(), str(first["page_id"]))
                    data = warc_from_arc(r, str(i), refers, {"X-Page-Id": str(i), "X-Payload-Length": str(len(payload))})
                    out.write(gzip_member(data))
                    size += len(data)
                    records += 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        yield done()
                        out = None
        if out is not None:
            out.close()
            yield done()

    return materialize(_roles(pages).mapInArrow(run, "file string, records long"), "archives")


def read(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, warc_date."""

    def run(batches):
        for b in batches:
            for name in column(b, "file").to_pylist():
                fs, path = filesystem(name)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for record in warc_members(stream):
                        f, block = parse_warc(record)
                        payload = split_http(block)[1]
                        revisit = f["WARC-Type"] == "revisit"
                        digest = bare_digest(f["WARC-Payload-Digest"])
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged record {f['WARC-Record-ID']}")
                        rows.append((int(f["X-Page-Id"]), int(f["X-Payload-Length"]) if revisit else len(payload), digest, f["WARC-Type"], f.get("WARC-Refers-To"), f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"]))
                        if len(rows) >= 1000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers string, record_id string, target_uri string, warc_date string"
    files = manifest.select("file").repartition(partitions(manifest.sparkSession), "file")
    rows = materialize(files.mapInArrow(run, kind), "records")
    used = rows.where("refers IS NOT NULL").groupBy("refers").agg(F.count("*").alias("n"))
    target = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers")).agg(F.max("page_id").alias("refers_to"))
    out = lookup(rows, materialize(used.join(target, "refers"), "referred"), ["refers"], "n", rows.count(), "page_id", "left")
    return out.select(real_id("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date")


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers", "record_id", "target_uri", "warc_date"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(write(read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {"op4_warc": SQL}
