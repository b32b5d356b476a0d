"""From legacy ARC archives to WARC archives, and back to rows.

An ARC file starts with a version block that names its field list; every record is one header
line in that version's fields, ending with the declared length of what follows. The converter
trusts that length alone to find the next record. Of what WARC asks for and ARC lacks, it makes
record identifiers (a name-based UUID of what the record is), timestamps, types and digests.
Equal payloads are kept once: one record holds them, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import common, files

LEAST_REVISIT = 1000
FILE_BYTES = 16 << 20
# Field lists of the two ARC versions and the WARC revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"

RECORD = "url string, date string, mime string, page_id long, payload binary, sha1 string, record_id string"
_RECORD = pa.schema([("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("page_id", pa.int64()),
                     ("payload", pa.binary()), ("sha1", pa.string()), ("record_id", pa.string())])


def _field(value: str | None) -> str:
    """A header field has no blanks; missing ones are a dash."""
    return "".join((value or "").split()) or "-"


def arc_bytes(version: int, date: str, records: list[tuple[str | None, int | None, bytes]]) -> bytes:
    """An ARC file of (url, page_id, payload) records in one of the two versions."""
    block = f"{version} 0 newsloom\n{ARC_FIELDS[version]}\n\n".encode()
    out = [_arc_line(version, "filedesc://pages.arc", "0.0.0.0", date, "text/plain", block)]
    for url, page, payload in records:
        head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        head += "" if page is None else f"X-Page-Id: {page}\r\n"
        body = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
        out.append(_arc_line(version, _field(url), "0.0.0.0", date, "text/html", body))
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, mime: str, body: bytes) -> bytes:
    between = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - 0 pages.arc"
    return f"{url} {ip} {date} {mime}{between} {len(body)}\n".encode() + body + b"\n"


def _arc_fields(names: list[str], line: str) -> dict[str, str] | None:
    """Fields of a header line; a content type may hold blanks. None if it is no header line.

    The URL, address and date stand first and the others last, so the version's field list tells
    where the content type begins and ends.
    """
    parts, after = line.split(), len(names) - 4
    if len(parts) < len(names) or not (parts[-1].isascii() and parts[-1].isdigit()):
        return None
    values = [*parts[:3], " ".join(parts[3:len(parts) - after]), *parts[len(parts) - after:]]
    return dict(zip(names, values, strict=True))


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by name, content) of every record after a version block.

    Files may be gzip members end to end. Each version block, the first or a later one, sets the
    field list of what follows; before the first, records are taken as version 1. A line that is
    no header line of that list, as one without a length, is passed over, and with it what follows
    up to the next header line. A last record cut short has the bytes that there are.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, names = 0, ARC_FIELDS[1].split()
    while 0 <= at < len(data):
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].decode("utf-8", "replace")
        at = end + 1 if end >= 0 else len(data)
        opens = line.startswith("filedesc:")
        fields = _arc_fields(ARC_FIELDS[1].split() if opens else names, line)
        if fields is None:
            continue
        length = int(fields["Archive-length"])
        content = data[at:at + length]
        at += length
        if not opens:
            yield fields, content
            continue
        lines = content.decode("utf-8", "replace").split("\n")
        version = lines[0].split(" ", 1)[0]
        given = lines[1].split() if len(lines) > 1 else []
        whole = {"URL", "Archive-date", "Content-type"} <= set(given[:4]) and given[-1] == "Archive-length"
        names = given if whole else ARC_FIELDS[2 if version == "2" else 1].split()


def split_http(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = content.partition(_CRLF + _CRLF)
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, payload


def iso_date(arc: str) -> str:
    """An ARC date of 14 (or 12) digits as a WARC-Date; one that is no date is the epoch's start."""
    for form in ("%Y%m%d%H%M%S", "%Y%m%d%H%M"):
        try:
            return datetime.strptime(arc, form).strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            continue
    return "1970-01-01T00:00:00Z"


def _record_id(url: str, date: str, page: int | None, sha1: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page} {sha1}')}"


def to_arc(pages: DataFrame, date: str = "20240101000000", key: str = "page_id", html: str = "html",
           url: str = "url") -> DataFrame:
    """(arc) of whole ARC files, in turn of both versions, one for every batch of pages."""
    schema = pa.schema([("arc", pa.binary())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(rows):
            payloads = [x.as_py() or b"" for x in batch.column(2).cast(pa.large_binary())]
            records = list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), payloads, strict=True))
            yield pa.RecordBatch.from_pydict({"arc": [arc_bytes(1 + number % 2, date, records)]}, schema=schema)

    return pages.select(F.col(key).cast("long"), F.col(url).cast("string"), common.text_of(html)).mapInArrow(run, "arc binary")


def convert(arcs: DataFrame) -> DataFrame:
    """Records of ARC files (column arc) with all that a WARC record needs."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in _RECORD.names}
            for arc in batch.column(0):
                for fields, content in parse_arc(arc.as_py() or b""):
                    http, payload = split_http(content)
                    page = http.get("x-page-id")
                    sha1, date = hashlib.sha1(payload).hexdigest(), iso_date(fields["Archive-date"])
                    number = int(page) if page is not None else None
                    values = (fields["URL"], date, fields["Content-type"], number, payload, sha1,
                              _record_id(fields["URL"], date, number, sha1))
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
            return out

        yield from common.batches(rows, _RECORD, make)

    return arcs.select("arc").mapInArrow(run, RECORD)


def with_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records with `target`, `target_url`, `target_date` of the equal record they revisit, else null.

    Payloads are equal if length, SHA-1 and SHA-256 are; of equal ones of at least `least` bytes
    that of the largest page_id is kept, a missing one being the least, then by record id. Equal
    records are found on rows without payload; payloads then meet their target by record id.
    """
    sized = records.select("record_id", "page_id", "url", "date", "sha1", F.octet_length("payload").alias("bytes"),
                           F.sha2(F.col("payload"), 256).alias("sha2"))
    narrow = common.written(sized.filter(F.col("bytes") >= least), "sizes")
    keepers = (narrow.groupBy("sha1", "sha2", "bytes")
               .agg(F.max(F.struct("page_id", "record_id", "url", "date")).alias("best"), F.count("*").alias("n"))
               .filter("n > 1").select("sha1", "sha2", "bytes", "best"))
    targets = common.written(
        narrow.join(keepers, ["sha1", "sha2", "bytes"]).filter(F.col("best.record_id") != F.col("record_id"))
        .select("record_id", *[F.col(f"best.{c}").alias(n) for c, n in (
            ("record_id", "target"), ("url", "target_url"), ("date", "target_date"))]).distinct(), "targets")
    return records.join(targets, "record_id", "left").select(*records.columns, "target", "target_url", "target_date")


def _warc_record(r: dict) -> bytes:
    size, revisit = len(r["payload"]), r["target"] is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: " + r["mime"].encode() + _CRLF
    if r["page_id"] is not None:
        http += f"X-Page-Id: {r['page_id']}\r\n".encode()
    block = http + f"Content-Length: {size}\r\n\r\n".encode() + (b"" if revisit else r["payload"])
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{r['record_id']}>"),
            ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(r["sha1"])).decode()),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
            ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{r['target']}>"),
                 ("WARC-Refers-To-Target-URI", r["target_url"]), ("WARC-Refers-To-Date", r["target_date"])]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + _CRLF + _CRLF


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """(file, records) of the .warc.gz files written to `folder`, a gzip member for every record."""
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, n, done = "", None, 0, 0, []
        for batch in rows:
            for row in batch.to_pylist():
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                        done.append((name, n))
                    name, out = files.create(folder, ".warc.gz")
                    at = n = 0
                member = gzip.compress(_warc_record(row), 5, mtime=0)
                out.write(member)
                at += len(member)
                n += 1
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "records": [c for _, c in done]}, schema=schema)

    return records.mapInArrow(run, "file string, records long")


def parse_warc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an open binary stream."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := file.readline().rstrip(_CRLF)):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, file.read(int(fields["content-length"]))


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the files in a manifest: record_id, type, page_id, bytes, sha1, target, payload_ok."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                        ("bytes", pa.int64()), ("sha1", pa.string()), ("target", pa.string()), ("payload_ok", pa.bool_())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name in batch.column(0).to_pylist():
                out: dict[str, list] = {n: [] for n in schema.names}
                with files.opened(folder, name) as raw, gzip.GzipFile(fileobj=raw) as file:
                    for fields, block in parse_warc(file):
                        http, payload = split_http(block)
                        sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = fields["warc-type"] == "revisit"
                        page = http.get("x-page-id")
                        values = (fields["warc-record-id"].strip("<>"), fields["warc-type"],
                                  int(page) if page is not None else None, int(http["content-length"]), sha1,
                                  fields.get("warc-refers-to", "").strip("<>") or None,
                                  revisit or hashlib.sha1(payload).hexdigest() == sha1)
                        for column, value in zip(out, values, strict=True):
                            out[column].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    spread = manifest.select("file").repartition(4 * common.partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, "record_id string, record_type string, page_id long, bytes long, sha1 string, "
                                  "target string, payload_ok boolean")


def archived(pages: DataFrame, folder: str, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Pages through ARC and WARC and back, one row a page: key, payload_bytes, payload_digest,
    record_type, refers_to.

    A null html is an empty payload and a null url a dash. A page without key is written and read
    like any other, with a null key. Whole rows that repeat are one record id; of equal payloads
    one record id is the response. Other columns are not read. A payload that does not match its
    digest raises. Pages are converted twice, once for their digests and once to be written, so no
    copy of the payloads is kept between the two.
    """
    records = convert(to_arc(pages, key=key, html=html, url=url))
    manifest = common.written(write_warc(with_revisits(records), folder), "manifest")
    rows = common.written(read_warc(manifest, folder), "read")
    if not rows.filter("NOT payload_ok").isEmpty():
        raise ValueError("a payload read back does not match its digest")
    targets = rows.filter("record_type = 'response'").groupBy("record_id").agg(F.max("page_id").alias("refers_to"))
    return rows.drop("payload_ok").join(targets.withColumnRenamed("record_id", "target"), "target", "left").select(
        F.col("page_id").alias(key), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        "record_type", "refers_to")
