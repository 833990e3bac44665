"""Legacy web archives: ARC files of either version, and their conversion to WARC.

An ARC record is a header line and as many bytes as the line declares. Version 1 has five fields,
version 2 ten; the file's first record says which. Fields are taken from the right, since old
crawlers left blanks in addresses. A converted record gets a WARC identifier (a UUID of its file's whole
address, place and payload, so that a run that is repeated makes the same), an ISO time, a type, and SHA-256
digests of block and payload. A payload that another record already holds becomes a revisit without
payload. A record that can't be read is reported, and reading goes on at the next header line.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AtomicFile, materialize, open_fs

_FIELDS = {1: 5, 2: 10}
_NAMES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_SPACE = uuid.UUID("8d3f7c5e-6a52-4c1e-9f0b-2f8a4f3e7d10")
_LAST = (1 << 63) - 1


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str  # 14 digits
    mime: str
    body: bytes
    status: str = "-"
    checksum: str = "-"


class ArcError(ValueError):
    """A header line or a declared length that the format doesn't allow."""


@dataclass
class ArcFault:
    """What was passed over instead of a record: the place of its header in the uncompressed stream."""

    offset: int
    reason: str


def arc_date(text: str) -> str:
    """14 digits of a date of 8 (day), 10 (hour), 12 (minute) or 14 digits."""
    if not re.fullmatch(r"\d{8}(?:\d\d){0,3}", text):
        raise ArcError(f"bad date {text!r}")
    text += "0" * (14 - len(text))
    try:
        datetime.strptime(text, "%Y%m%d%H%M%S")
    except ValueError:
        raise ArcError(f"bad date {text!r}") from None
    return text


def _fields(line: bytes, version: int | None) -> tuple[list[bytes], int]:
    """Fields of a header line, and the declared length."""
    fields = line.rsplit(b" ", _FIELDS[version or 1] - 1)
    if version is None and len(line.split(b" ")) == _FIELDS[2]:
        fields = line.split(b" ")
    if len(fields) not in _FIELDS.values() or not fields[-1].isdigit():
        raise ArcError(f"bad header line {line[:200]!r}")
    return fields, int(fields[-1])


def read_arc(stream, strict: bool = False) -> Iterator[ArcRecord | ArcFault]:
    """Records of an uncompressed ARC stream, without the version record.

    A line that is no header gives one fault, and reading goes on at the next line that is one; a date
    that isn't one gives a fault instead of its record. A record that ends early is the last fault.
    With ``strict`` the first fault is raised as ArcError. Without a version block nothing is read.
    """
    version, at, lost = None, 0, False

    def fault(place: int, reason: str) -> ArcFault:
        if strict:
            raise ArcError(reason)
        return ArcFault(place, reason)

    while line := stream.readline():
        place, at = at, at + len(line)
        if not line.strip():
            continue
        line = line.rstrip(b"\r\n")
        if version is None and not line.startswith(b"filedesc:"):
            yield fault(place, "the first record isn't a version block")
            return
        try:
            fields, size = _fields(line, version)
            if lost and not re.fullmatch(rb"\d{8,14}", fields[2]):
                raise ArcError("not a header line")
        except ArcError as error:
            if not lost:
                yield fault(place, str(error))
                lost = True
            if version is None:
                return
            continue
        lost = False
        body = stream.read(size)
        if len(body) < size:
            yield fault(place, f"{size} bytes are declared, {len(body)} are left")
            return
        at += size
        if version is None:
            head = body.split(b" ", 1)[0].strip()
            version = int(head) if head.isdigit() else 0
            if version not in _FIELDS:
                yield fault(place, f"version {version} isn't known")
                return
            continue
        text = [f.decode("utf-8", "replace") for f in fields]
        try:
            date = arc_date(text[2])
        except ArcError as error:
            yield fault(place, str(error))
            continue
        status, checksum = (text[4], text[5]) if version == 2 else ("-", "-")
        yield ArcRecord(text[0], text[1], date, text[3], body, status, checksum)


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = b"%d 0 corpusloom\n%s\n\n" % (version, _NAMES[version])
    extra = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(record: ArcRecord, version: int, name: str, offset: int) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", record.url) or "-"
    extra = f" {record.status} {record.checksum} - {offset} {name}" if version == 2 else ""
    return f"{url} {record.ip} {record.date} {record.mime}{extra} {len(record.body)}\n".encode() + record.body + b"\n"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, of either kind of line end, and payload. Without a head all is payload."""
    if body.startswith(b"HTTP/"):
        blank = re.search(rb"\r?\n\r?\n", body)
        if blank:
            return body[: blank.end()], body[blank.end() :]
    return b"", body


def record_name(file: str, ordinal: int, payload_digest: str) -> str:
    """Whole address of the ARC file, place in it, and payload: no two records have the same."""
    return f"{file}#{ordinal}#{payload_digest}"


def target_name(source: str) -> str:
    """Name of the WARC file of an ARC file; those of equal names in different folders differ."""
    base = source.rsplit("/", 1)[-1]
    stem, dot, rest = base.partition(".arc")
    return f"{stem}-{hashlib.sha256(source.encode()).hexdigest()[:12]}.warc{rest if dot else ''}"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def to_warc(record: ArcRecord, name: str, refers_to: str | None = None, extra: tuple[tuple[str, str], ...] = ()) -> bytes:
    """The WARC record of an ARC record; with ``refers_to``, a record name, a revisit of that one."""
    head, payload = split_http(record.body)
    d = record.date
    block = head if refers_to is not None else record.body
    fields = [
        ("WARC-Type", "response" if refers_to is None and head else "resource" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(name)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("X-Payload-Length", str(len(payload))),
        *extra,
        *([("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to is not None else ()),
        ("Content-Type", "application/http; msgtype=response" if head else record.mime),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if "sha256:" + hashlib.sha256(block).hexdigest() != fields["warc-block-digest"]:
            raise ValueError(f"{fields['warc-record-id']}: the block differs from its digest")
        yield fields, block


def _member(data: bytes, level: int) -> bytes:
    """One gzip member, without a time, so that it is the same each time it is made."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open_gzip(uri: str):
    system, path = open_fs(uri)
    return io.BufferedReader(gzip.GzipFile(fileobj=system.open_input_stream(path, compression=None, buffer_size=1 << 20)), 1 << 18)


_RECORDS = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string())])
_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string())])


def write_arc_files(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000", level: int = 1) -> DataFrame:
    """Archive rows in ARC files, one a task, versions 1 and 2 by turns; a row for each record.

    The tasks are those of the scan, so nothing is shuffled, and a task that is run again writes the
    same file. A null html is an empty payload, a null address ``-``, a null id has no id header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version, name, file, n = 1 + task % 2, f"part-{task:06d}.arc.gz", None, 0
        for batch in batches:
            rows = []
            for key, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file is None:
                    file = AtomicFile(f"{out_dir}/{name}")
                    file.write(_member(arc_version_block(name, version, date), level))
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                own = f"X-Record-Key: {key}\r\n" if key is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n"
                record = ArcRecord(url or "-", "0.0.0.0", date, "text/html", head.encode() + payload, "200", digest[:16])
                file.write(_member(arc_record(record, version, name, file.size), level))
                rows.append((f"{out_dir}/{name}", n, key, len(payload), digest))
                n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)
        if file is not None:
            file.commit()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "file string, ordinal long, page_id long, payload_bytes long, digest string")


def repeated_payloads(records: DataFrame, least: int = 100) -> DataFrame:
    """For each file the payloads of ``least`` bytes or more that some other record also has.

    One row a file: its list of (digest, first_id, first_file, first_ordinal), no longer than the
    file. Digests are counted within a file before anything is shuffled, so a payload that a third of
    all rows share comes with one row a file. First is the smallest id (null last), then the place.
    """
    own = F.struct(F.coalesce("page_id", F.lit(_LAST)).alias("id"), F.col("file").alias("first_file"), F.col("ordinal").alias("first_ordinal"))
    local = records.where(F.col("payload_bytes") >= least).groupBy("file", "digest").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = local.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    found = local.select("file", "digest").join(groups, "digest")
    return found.groupBy("file").agg(F.collect_list(F.struct("digest", F.col("first.id").alias("id"), F.col("first.first_file").alias("first_file"), F.col("first.first_ordinal").alias("first_ordinal"))).alias("repeats"))


def convert_arc_files(files: DataFrame, out_dir: str, level: int = 2) -> DataFrame:
    """Convert each ARC file of ``files`` (file, repeats or null) to a WARC file.

    A record whose payload digest is among the repeats refers to their first, unless it is that one.
    Returns source, file, n_records, and faults: offset and reason of what was passed over.
    """
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("reason", pa.string())]))
    fields = pa.schema([("source", pa.string()), ("file", pa.string()), ("n_records", pa.int64()), ("faults", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, repeats in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = {r["digest"]: r for r in repeats or ()}
                target = f"{out_dir}/{target_name(source)}"
                file, n, faults = AtomicFile(target), 0, []
                with _open_gzip(source) as stream:
                    for record in read_arc(stream):
                        if isinstance(record, ArcFault):
                            faults.append({"offset": record.offset, "reason": record.reason})
                            continue
                        digest = hashlib.sha256(split_http(record.body)[1]).hexdigest()
                        first = known.get(digest)
                        refers, extra = None, ()
                        if first and (first["first_file"], first["first_ordinal"]) != (source, n):
                            refers = record_name(first["first_file"], first["first_ordinal"], digest)
                            extra = () if first["id"] == _LAST else (("X-Refers-To-Key", str(first["id"])),)
                        file.write(_member(to_warc(record, record_name(source, n, digest), refers, extra), level))
                        n += 1
                file.commit()
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([target]), pa.array([n], pa.int64()), pa.array([faults], kind)], schema=fields)

    n = max(1, files.count())
    return files.select("file", "repeats").repartition(n, "file").mapInArrow(run, "source string, file string, n_records long, faults array<struct<offset:long,reason:string>>")


def read_warc_files(files: DataFrame) -> DataFrame:
    """Read records back: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                rows = []
                with _open_gzip(source) as stream:
                    for fields, block in read_warc(stream):
                        head, payload = split_http(block)
                        key = re.search(rb"\r\nX-Record-Key: (-?\d+)\r\n", head)
                        kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2], int(fields["x-payload-length"])
                        if kind != "revisit":
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
                        other = fields.get("x-refers-to-key")
                        rows.append((int(key[1]) if key else None, size, digest, kind, int(other) if other else None, fields["warc-record-id"], fields["warc-target-uri"]))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, files.count())
    return files.select("file").repartition(n, "file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BACK)], schema=_BACK)


def archive_pages(pages: DataFrame, out_dir: str, least: int = 100, **columns: str) -> DataFrame:
    """Pages to ARC, ARC to WARC with revisits, and the WARC files read back.

    Rows may repeat: of equal rows the first in place is the response. A null html is an empty payload,
    a null id comes back as null and is the last choice for a response; a very long html is one record in
    the memory of its task. An empty table gives no file and no row. Other columns are ignored.
    """
    records = materialize(write_arc_files(pages, f"{out_dir}/arc", **columns), "arc-records")
    files = materialize(records.select("file").distinct().join(repeated_payloads(records, least), "file", "left"), "arc-files")
    return read_warc_files(materialize(convert_arc_files(files, f"{out_dir}/warc"), "warc-files"))


REPORT_SQL = """
WITH paid AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM paid),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM firsts"""
