"""Conversion of legacy ARC archives to WARC records, and reading those back.

An archive is a binary value, one per row of a table: an ARC member holds a version block and the records after it, a
WARC member a warcinfo record and the converted ones. Tables of archives are read and written by Spark, so that a task
run again replaces what it wrote before.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

# Fixed values of the formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length",
    ),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payloads below this many bytes are never stored as revisits.
MIN_REVISIT_BYTES = 100
# A member is closed after the record that brings it to this many bytes.
MEMBER_BYTES = 8 << 20

_ARCHIVE = "part int, member int, version int, data binary"
_RECORD = (
    "part int, member int, offset long, uri string, date string, ip string, record_key string, payload_bytes long, "
    "payload_digest string, record_id string, block binary, content_type string"
)


class ArcError(ValueError):
    """An ARC member whose header lines or lengths do not fit, from this offset on."""

    def __init__(self, message: str, offset: int):
        super().__init__(f"{message} at {offset}")
        self.offset = offset


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, offset: int = 0, name: str = "-") -> bytes:
    """The header line of one ARC record. Blanks in the address would end a field, so they are percent-encoded."""
    url = urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))) or "-"
    more = () if version == 1 else ("200", "-", "-", str(offset), name)
    return (" ".join((url, ip, date, kind, *more, str(length))) + "\n").encode()


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC member. It names the version and the fields of the header lines."""
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), 0, name) + body + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC member after its version block: fields of the header line, offset and content.

    The field names come from the version block; the number of fields is checked in each header line and the declared length
    against what follows. Records are ended by a line feed.
    """
    at, names, version = 0, None, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError("header line without end", at)
        parts = data[at:end].decode("utf-8", "surrogateescape").split(" ")
        if names is None:
            if not parts[0].startswith("filedesc://"):
                raise ArcError("no version block", at)
        elif len(parts) != len(names):
            raise ArcError(f"{len(parts)} fields, version {version} has {len(names)},", at)
        if not re.fullmatch("[0-9]{1,18}", parts[-1]) or end + 1 + int(parts[-1]) > len(data):
            raise ArcError("declared length does not fit", at)
        body = data[end + 1 : end + 1 + int(parts[-1])]
        if names is None:
            first, fields, *_ = [*body.decode("utf-8", "surrogateescape").split("\n"), ""]
            version = {str(v): v for v in ARC_FIELDS}.get(first.split(" ")[0])
            names = tuple(fields.split(" "))
            if version is None or ARC_FIELDS[version] != names:
                raise ArcError("unknown version", at)
        else:
            fields = dict(zip(names, parts))
            try:
                date = warc_date(fields["Archive-date"])
                parts[0].encode("utf-8")
            except ValueError:
                raise ArcError("no date or address", at) from None
            yield fields | {"offset": at, "version": version, "content": body, "date": date}
        at = end + 1 + int(parts[-1])


def warc_date(arc_date: str) -> str:
    """`20240131235959` as `2024-01-31T23:59:59Z`. Shorter dates are filled up to the start of their span."""
    filled = arc_date + "00000101000000"[len(arc_date) :]
    return dt.datetime.strptime(filled, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*what: str) -> str:
    """The same identifier for the same record, whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(what))}>"


def sha256_field(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def payload_of(block: bytes, content_type: str | None = None) -> bytes:
    """The body of an HTTP response, or the whole block if it is none."""
    if block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, length = end + 4, int(headers["content-length"])
        yield headers, data[start : start + length]
        at = start + length + 4


def http_block(key: str, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: {key}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arc(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """Pages as a table of ARC members, of version 1 and 2 in turn. Each task cuts its rows into members as they come.

    A null address is written as `-`, a null html as an empty body, a null key as an empty one.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, member, data, version = TaskContext.get().partitionId(), 0, bytearray(), 1

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "member": [member], "version": [version], "data": [bytes(data)]})

        for batch in batches:
            for key, url, html in zip(batch["key"], batch["url"], batch["html"]):
                if not data:
                    name, version = f"{part}-{member}.arc", 1 + member % 2
                    data += version_block(version, name, date)
                block = http_block(key, html.encode("utf-8"))
                data += arc_header(version, url, "0.0.0.0", date, "text/html", len(block), len(data), name) + block + b"\n"
                if len(data) >= MEMBER_BYTES:
                    yield closed()
                    member, data = member + 1, bytearray()
        if data:
            yield closed()

    text = {"key": key_col, "url": url_col, "html": html_col}
    return pages.select(*(text_or_empty(c).alias(n) for n, c in text.items())).mapInPandas(members, _ARCHIVE)


def arc_records(archives: DataFrame, strict: bool = True) -> DataFrame:
    """The records of ARC members with what their WARC forms need: identifier, date, type, digest and block.

    A malformed member ends the job with an `ArcError`. With `strict` off its records up to the malformed one come out, and
    `arc_errors` tells where each such member breaks off.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, member, data in zip(batch["part"], batch["member"], batch["data"]):
                rows, size = [], 0
                for r in read_arc(bytes(data)) if strict else _readable(bytes(data)):
                    payload = payload_of(r["content"])
                    key = re.search(rb"\r\nX-Record-Key: ([^\r]*)\r\n", r["content"][:4096])
                    rows.append((
                        part, member, r["offset"], r["URL"], r["date"], r["IP-address"],
                        key[1].decode() if key else None, len(payload), hashlib.sha256(payload).hexdigest(),
                        record_id(str(part), str(member), str(r["offset"]), r["URL"]), r["content"],
                        "application/http; msgtype=response" if r["content"].startswith(b"HTTP/") else r["Content-type"],
                    ))
                    size += len(r["content"])
                    if size >= MEMBER_BYTES:
                        yield pd.DataFrame(rows, columns=_names(_RECORD))
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_names(_RECORD))

    return archives.select("part", "member", "data").mapInPandas(parsed, _RECORD)


def _readable(data: bytes) -> Iterator[dict]:
    try:
        yield from read_arc(data)
    except ArcError:
        return


def arc_errors(archives: DataFrame) -> DataFrame:
    """part, member, offset, n_records and error of each malformed ARC member: where it breaks off and how many records stand before."""
    schema = "part int, member int, offset long, n_records long, error string"

    def broken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, member, data in zip(batch["part"], batch["member"], batch["data"]):
                n = 0
                try:
                    for _ in read_arc(bytes(data)):
                        n += 1
                except ArcError as e:
                    yield pd.DataFrame([(part, member, e.offset, n, str(e))], columns=_names(schema))

    return archives.select("part", "member", "data").mapInPandas(broken, schema)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def originals(records: DataFrame, order: list[str]) -> DataFrame:
    """Per payload that repeats and is long enough: its first record in `order` (nulls last), with identifier, address and date."""
    long = records.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    known = [x for i, c in enumerate(order) for x in (F.isnull(c).alias(f"unknown_{i}"), F.col(c).alias(f"order_{i}"))]
    first = F.min(F.struct(*known, "part", "member", "offset", "record_id", "uri", "date", "record_key"))
    found = long.groupBy("payload_digest", "payload_bytes").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    return found.filter("copies > 1")


def write_warc(records: DataFrame, first: DataFrame) -> DataFrame:
    """Records as a table of WARC members: of equal payloads the first record in full, the others as its revisits."""
    ref = first.select(
        "payload_digest", "payload_bytes", F.col("first.record_id").alias("to_id"), F.col("first.uri").alias("to_uri"),
        F.col("first.date").alias("to_date"),
    )
    joined = records.join(ref, ["payload_digest", "payload_bytes"], "left")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, member, data = TaskContext.get().partitionId(), 0, bytearray()

        def closed() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "member": [member], "version": [11], "data": [bytes(data)]})

        for batch in batches:
            for r in batch.itertuples(index=False):
                if not data:
                    info = b"software: regmart\r\nformat: WARC File Format 1.1\r\n"
                    data += warc_record({
                        "WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", str(part), str(member)),
                        "WARC-Date": r.date, "Content-Type": "application/warc-fields",
                    }, info)
                block = bytes(r.block)
                headers = {
                    "WARC-Type": "response", "WARC-Record-ID": r.record_id, "WARC-Target-URI": r.uri, "WARC-Date": r.date,
                    "WARC-IP-Address": r.ip, "Content-Type": r.content_type,
                    "WARC-Payload-Digest": sha256_field(payload_of(block)),
                }
                if isinstance(r.to_id, str) and r.to_id != r.record_id:
                    headers |= {
                        "WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": r.to_id,
                        "WARC-Refers-To-Target-URI": r.to_uri, "WARC-Refers-To-Date": r.to_date,
                        "WARC-Payload-Length": str(r.payload_bytes),
                    }
                    block = block[: len(block) - r.payload_bytes]
                data += warc_record(headers | {"WARC-Block-Digest": sha256_field(block)}, block)
                if len(data) >= MEMBER_BYTES:
                    yield closed()
                    member, data = member + 1, bytearray()
        if data:
            yield closed()

    return joined.mapInPandas(members, _ARCHIVE)


def convert(arc: DataFrame, order: list[str], strict: bool = True) -> DataFrame:
    """ARC members (a table that can be read again) as a table of WARC members, `order` being record columns.

    Of payloads of at least `MIN_REVISIT_BYTES` bytes that are equal by digest and length, the record that comes first in
    `order` (nulls last) is stored in full; ties go by place in the archives. A payload that many records share costs one row per
    task in the search for it. Malformed members are treated as `arc_records` says.
    """
    return write_warc(arc_records(arc, strict), originals(arc_records(arc, strict).drop("block"), order))


def read_records(archives: DataFrame) -> DataFrame:
    """The response and revisit records of WARC members. Digests are checked against the blocks that are there."""
    schema = (
        "record_id string, record_type string, target_uri string, date string, record_key string, payload_bytes long, "
        "payload_digest string, refers_to_id string"
    )

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                rows = []
                for h, block in read_warc(bytes(data)):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    if sha256_field(block) != h["warc-block-digest"]:
                        raise ValueError(f"{h['warc-record-id']}: the block is not the one that was written")
                    key = re.search(rb"\r\nX-Record-Key: ([^\r]*)\r\n", block[:4096])
                    digest = h["warc-payload-digest"].removeprefix("sha256:")
                    size = h.get("warc-payload-length")
                    if h["warc-type"] == "response" and sha256_field(payload_of(block)) != h["warc-payload-digest"]:
                        raise ValueError(f"{h['warc-record-id']}: the payload is not the one that was written")
                    rows.append((
                        h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"],
                        key[1].decode() if key else None, len(payload_of(block)) if size is None else int(size),
                        base64.b32decode(digest + "=" * (-len(digest) % 8)).hex(), h.get("warc-refers-to"),
                    ))
                yield pd.DataFrame(rows, columns=_names(schema))

    return archives.select("data").mapInPandas(parsed, schema)


def op8_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as ARC members, those as WARC members, and the records read back from these.

    A null html is an empty payload. Of equal payloads that with the smallest page_id is the response; a null id comes after all
    others, and where all ids are null the one that was read first is it, and `refers_to` is null. An empty table gives no rows; columns
    other than page_id, url and html are not looked at.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arc = written(write_arc(pages))
    warc = written(convert_pages(arc))
    found = written(read_records(warc).withColumn("page_id", F.expr("try_cast(record_key as bigint)")))
    # Only repeated payloads are referred to, so few rows are looked up.
    named = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    revisits = found.filter("record_type = 'revisit'").join(named, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = found.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.select(*columns).unionByName(revisits.select(*columns))


def convert_pages(arc: DataFrame) -> DataFrame:
    """`convert` with records in ascending order of their numeric keys."""
    records = arc_records(arc).withColumn("number", F.expr("try_cast(record_key as bigint)"))
    return write_warc(records.drop("number"), originals(records.drop("block"), ["number"]))


QUERIES = {"op8_arc_to_warc": op8_arc_to_warc}
ORACLE = {
    "op8_arc_to_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f"""
}
