"""Web archives: a converter from legacy ARC files to WARC, a WARC writer and a reader.

ARC: a version block, ``filedesc://name IP date text/plain length``, whose text starts with the version number, then
records: a header line, as many bytes as it declares, a line end.  Version 1 lines are ``URL IP date type length``;
version 2 lines are ``URL IP date type result checksum location offset filename length``.  A URL may hold blanks, so
fields are counted from the right.

WARC: records of named fields, each its own gzip member.  The converter derives what ARC lacks: record identifiers
(UUIDs from URL, date and page), ISO timestamps, types (response for HTTP, resource for others, warcinfo for the version
block) and SHA-1 digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import by_file, fresh_dir, joined_small, table, utf8, written
from tideway.llm.token_store import opened

#: The fields of a header line by ARC version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
ARC_BYTES = 4 << 20
BROADCAST_REVISITS = 1_000_000


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    body: bytes


def arc_date(text: str) -> str:
    """An ARC date of up to 14 digits as ISO 8601; missing parts are the earliest."""
    if not re.fullmatch(r"\d{4,14}", text):
        raise ValueError(f"not an ARC date: {text!r}")
    t = text + "00000101000000"[len(text) :]
    return f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_line(text: str | None) -> str:
    """Text as one ARC field: blanks and control characters percent-encoded, nothing as a dash."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "") or "-"


def write_arc(records: list[tuple[dict[str, str], bytes]], version: int, name: str, date: str) -> bytes:
    """An uncompressed ARC file.  Each record: its fields but for length, and its body."""
    names = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "length": "Archive-length", "result": "Result-code"}.get(f, f.capitalize()) for f in ARC_FIELDS[version])
    about = f"{version} 0 tideway\n{names}\n".encode()
    tail = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    if version == 2:
        tail += f"200 - - 0 {name} "
    out = [f"{tail}{len(about)}\n".encode(), about, b"\n"]
    for fields, body in records:
        line = " ".join([*(fields.get(f) or "-" for f in ARC_FIELDS[version][:-1]), str(len(body))])
        out += [line.encode(), b"\n", body, b"\n"]
    return b"".join(out)


def unzipped(data: bytes) -> bytes:
    """The content of gzip members one after the other, as ARC files are kept; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        if not z.eof:
            raise ValueError("a gzip member has no end")
        data = z.unused_data
    if out and data.strip(b"\0"):
        raise ValueError("something else follows the gzip members")
    return b"".join(out) if out else data


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or gzipped by record, its version block first; a line or length that doesn't fit
    raises ValueError."""
    data = unzipped(data)
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"a header line at {at} has no end")
        line = data[at:end].decode(errors="replace").rstrip("\r")
        if not version:
            size = line.rpartition(" ")[2]
            head = data[end + 1 : end + 1 + 64].split(b" ", 1)[0]
            if not line.startswith("filedesc:") or not size.isdigit() or head not in (b"1", b"2"):
                raise ValueError("it doesn't start with a version block of version 1 or 2")
            version = int(head)
        names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) and not line.startswith("filedesc:"):
            raise ValueError(f"a version {version} line has {len(values)} fields: {line[:80]!r}")
        if len(values) != len(names):  # some writers keep a version 1 line in the block of a version 2 file
            values = line.rsplit(" ", 4)
            names = ARC_FIELDS[1]
        fields = dict(zip(names, values, strict=True))
        if not fields["length"].isdigit() or end + 1 + int(fields["length"]) > len(data):
            raise ValueError(f"declared length {fields['length']!r} at {at} doesn't fit")
        body = data[end + 1 : end + 1 + int(fields["length"])]
        yield ArcRecord(version, fields, body)
        at = end + 1 + len(body)


def http_split(body: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload)."""
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if end >= 0 else (body, b"")


def record_id(url: str, date: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page}')}>"


def head_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode(errors="replace") if found else None


def to_warc(record: ArcRecord, original: tuple[str, str] | None = None) -> bytes:
    """The equivalent WARC record, uncompressed.  original: (page, URL) of the response that this one repeats."""
    f, body = record.fields, record.body
    date = arc_date(f["date"])
    fields = {"WARC-Date": date}
    if f["url"].startswith("filedesc:"):
        kind, media = "warcinfo", "application/warc-fields"
        body = f"software: tideway\r\nformat: WARC File Format 1.1\r\nisPartOf: {f['url'][11:]}\r\n".encode()
        fields |= {"WARC-Record-ID": record_id(f["url"], date, ""), "WARC-Filename": f["url"][11:]}
    else:
        fields |= {"WARC-Target-URI": f["url"], "WARC-IP-Address": f["ip"]}
        if body.startswith(b"HTTP/"):
            head, payload = http_split(body)
            page = head_value(head, b"X-Page-Id") or ""
            kind, media = "response", "application/http; msgtype=response"
            fields |= {"WARC-Record-ID": record_id(f["url"], date, page), "WARC-Payload-Digest": "sha1:" + sha1(payload)}
            if original:
                kind, body = "revisit", head
                fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(original[1], date, original[0]), "WARC-Refers-To-Target-URI": original[1], "WARC-Refers-To-Date": date, "X-Refers-To-Page-Id": original[0]}
        else:
            kind, media = "resource", f["type"]
            fields |= {"WARC-Record-ID": record_id(f["url"], date, ""), "WARC-Payload-Digest": "sha1:" + sha1(body)}
    fields = {"WARC-Type": kind, **fields, "WARC-Block-Digest": "sha1:" + sha1(body), "Content-Type": media, "Content-Length": str(len(body))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def read_warc(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file of gzip members; a wrong length or digest raises ValueError."""
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        left, z, raw = b"", zlib.decompressobj(31), []
        while True:
            left = left or f.read(1 << 20)
            if not left:
                if raw:
                    raise ValueError(f"{uri} ends inside a record")
                return
            raw.append(z.decompress(left))
            left = z.unused_data if z.eof else b""
            if z.eof:
                record, z = b"".join(raw), zlib.decompressobj(31)
                raw = []
                head, _, rest = record.partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                fields = dict(x.split(": ", 1) for x in lines[1:])
                block = rest[: int(fields["Content-Length"])]
                if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + sha1(block):
                    raise ValueError(f"{uri}: a record of type {fields.get('WARC-Type')} is damaged")
                yield fields, block


def write_pages(pages: DataFrame, folder: str, date: str = "20240101000000", revisit_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive pages as ARC records, convert them and write WARC files to ``folder``; returns a manifest (uri, records).

    Of pages with equal payloads of at least ``revisit_from`` bytes, that with the smallest id is the response, others
    revisit it.  Null html is an empty payload; a null URL becomes ``urn:page:<id>``; a null id is never a first one but
    may revisit; equal ids with equal payloads are all responses; an empty table gives an empty manifest.
    """
    body = utf8(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("url"), body.alias("body"), F.sha1(body).alias("digest"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))  # no id reads like a null one
    sums = rows.filter(F.octet_length("body") >= revisit_from).select("id", "url", "digest")
    firsts = sums.groupBy("digest").agg(F.min("id").alias("first"), F.min_by("url", "id").alias("first_url"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    again = written(
        sums.join(firsts, "digest").filter("not (id <=> first)").select(key.alias("key"), "digest", "first", "first_url").dropDuplicates(["key", "digest"]), "revisits"
    )
    dealt = joined_small(rows.withColumn("key", key), again, ["key", "digest"], "left", again.count(), BROADCAST_REVISITS).select("id", "url", "body", "first", "first_url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = uri = None
        size = records = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([records], pa.int64())})

        def flushed(batch: list, version: int) -> list[bytes]:
            name = f"pages-{uuid.uuid4().hex}.arc"
            arc = write_arc([x[:2] for x in batch], version, name, date)
            originals = iter([None, *(x[2] for x in batch)])
            return [gzipped(to_warc(r, next(originals))) for r in read_arc(arc)]

        waiting: dict[int, list] = {1: [], 2: []}
        room = ARC_BYTES

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal out, uri, size, records
            for version, batch in waiting.items():
                if not batch:
                    continue
                if out is None:
                    uri, size, records = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, path = opened(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                for member in flushed(batch, version):
                    out.write(member)
                    size += len(member)
                    records += 1
                batch.clear()
                if size > FILE_BYTES:
                    yield done()
                    out = None

        for b in batches:
            for page, url, payload, first, first_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
                version = 1 + (page or 0) % 2
                fields = {"url": arc_line(url), "ip": "0.0.0.0", "date": date, "type": "text/html", "result": "200"}
                waiting[version].append((fields, head + payload, None if first is None else (str(first), arc_line(first_url))))
                room -= len(payload)
                if room <= 0:
                    yield from settle()
                    room = ARC_BYTES
        yield from settle()
        if out is not None:
            yield done()

    return written(dealt.mapInArrow(archive, "uri string, records long"), "warc-manifest")


def read_pages(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page record, verified while read: blocks
    and payloads against their digests, and revisits against a response of the page and digest that they refer to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for b in batches:
            for uri, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, seen = [], 0
                for fields, block in read_warc(uri):
                    seen += 1
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    head, payload = http_split(block)
                    page, declared, given = head_value(head, b"X-Page-Id"), int(head_value(head, b"Content-Length") or len(payload)), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != declared or sha1(payload) != given):
                        raise ValueError(f"{uri}: the payload of page {page} is damaged")
                    refers = fields.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, declared, given, fields["WARC-Type"], int(refers) if refers else None))
                if seen != n:
                    raise ValueError(f"{uri} has {seen} records, the manifest {n}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    rows = written(by_file(manifest.select("uri", "records")).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    wanted = rows.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    lost = wanted.join(rows.filter("record_type = 'response'").select("page_id", "payload_digest"), ["page_id", "payload_digest"], "left_anti").first()
    if lost:
        raise ValueError(f"no response of page {lost['page_id']} has the payload {lost['payload_digest']} that a revisit refers to")
    return rows


def convert_arcs(files: DataFrame, folder: str) -> DataFrame:
    """Convert ARC files given as rows (path, content), as Spark's binaryFile source reads them; returns the manifest.

    A file that isn't a whole ARC file of version 1 or 2 fails the job with its path.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                uri, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                fs, where = opened(uri)
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(where, compression=None) as out:
                    try:
                        for n, record in enumerate(read_arc(content), 1):  # noqa: B007
                            out.write(gzipped(to_warc(record)))
                    except ValueError as e:
                        raise ValueError(f"{path}: {e}") from e
                yield pa.RecordBatch.from_pydict({"uri": [uri], "records": pa.array([n], pa.int64())})

    return written(files.select("path", "content").mapInArrow(convert, "uri string, records long"), "warc-manifest")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(write_pages(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc")))
