"""Legacy web archives: ARC files read by their own header lines, converted to WARC, written and read back.

An ARC file opens with a version block that names the fields of its URL records: version 1 has URL, IP
address, date, content type and length; version 2 adds result code, checksum, location, offset and file
name.  A record is its header line and exactly the declared length of bytes, whatever they hold.  Conversion
gives each record a WARC identifier made from what it holds, an ISO timestamp, a type and SHA-1 digests; of
records with equal payloads one stays a response and the others become revisits that name it.

Files are written with Spark's text writer, one line each that is a whole archive but for its last line feed,
so that a file holds an archive's bytes (gzipped), on any file system that Spark writes to.  Archives are cut
at FILE_BYTES, or after one longer record.  Reading takes a file at a time, from Spark's binary reader.

Cases: a null payload is an empty one and a null URL an empty one; URLs keep their bytes, blanks and control
characters percent-encoded; rows without an id are records without one, and are never taken for the response
of a record that has an id; rows alike in id and payload are as many records, one of them the response if it
holds the largest id; a file cut short or with a bad header line raises ValueError; empty tables give files
without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import new_path, store

#: Bytes of payload a file is meant to hold.
FILE_BYTES = 16 << 20
#: The fields of the header lines by ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ID_HEADER = "X-Page-Id"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def quoted(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


# ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = ["text/plain"] if version == 1 else ["text/plain", "200", "-", "-", "0", name]
    return f"filedesc://{name} 0.0.0.0 {date} {' '.join(rest)} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, name: str = "-") -> bytes:
    rest = ["text/html"] if version == 1 else ["text/html", "200", "-", "-", "0", name]
    return f"{url or '-'} 0.0.0.0 {date} {' '.join(rest)} {len(block)}\n".encode() + block + b"\n"


def http_block(payload: bytes, page_id: int | None) -> bytes:
    own = "" if page_id is None else f"{ID_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def parse_arc(data: bytes) -> Iterator[dict]:
    """The URL records of one file: version, offset, url, ip, date, content_type, block."""
    at, fields, version = 0, None, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the line feed that parts records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} has no end")
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        words = line.split(" ")
        try:
            length = int(words[-1])
        except ValueError:
            raise ValueError(f"ARC header line at byte {at} declares no length: {line[:80]!r}") from None
        block = data[end + 1 : end + 1 + length]
        if length < 0 or len(block) < length:
            raise ValueError(f"ARC record at byte {at} is cut short")
        if words[0].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            fields = lines[1].split(" ") if len(lines) > 1 and lines[1] else list(ARC_FIELDS.get(version, ()))
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
        else:
            if fields is None:
                raise ValueError(f"ARC record at byte {at} stands before the version block")
            extra = len(words) - len(fields)
            if extra < 0:
                raise ValueError(f"ARC header line at byte {at} has {len(words)} fields, not {len(fields)}")
            named = dict(zip(fields, [" ".join(words[: extra + 1]), *words[extra + 1 :]]))  # only a URL may hold blanks
            yield {"version": version, "offset": at, "url": named["URL"], "ip": named["IP-address"], "date": named["Archive-date"], "content_type": named["Content-type"], "block": block}
        at = end + 1 + length


# WARC


def iso(date: str) -> str:
    """14 digits (fewer are filled up) to a WARC timestamp; what isn't a date gives the epoch."""
    try:
        return datetime.strptime((date + "19700101000000"[len(date) :])[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, payload_digest: str, url: str, date: str) -> str:
    """A UUID: of version 8 with 58 bits of a hash of the record and the 64 of the page's id, or without an id of version 5 with a hash."""
    h = int.from_bytes(hashlib.sha256(f"{payload_digest}\n{url}\n{date}".encode("utf-8", "surrogateescape")).digest()[:16], "big")
    version, tail = (5, h & (2**64 - 1)) if page_id is None else (8, page_id % 2**64)
    s = f"{h >> 80:012x}{version:x}{(h >> 64 & 0x3FF) << 2 | tail >> 62:03x}{2 << 62 | tail & (2**62 - 1):016x}"
    return f"<urn:uuid:{s[:8]}-{s[8:12]}-{s[12:16]}-{s[16:20]}-{s[20:]}>"


def page_of(urn: str | None) -> int | None:
    """The page id in a record's URN."""
    s = (urn or "").removeprefix("<urn:uuid:").rstrip(">").replace("-", "")
    if len(s) != 32 or s[12] != "8":
        return None
    n = (int(s[15], 16) & 3) << 62 | int(s[16:], 16) & (2**62 - 1)
    return n - 2**64 if n >= 2**63 else n


def split_http(block: bytes) -> tuple[bytes, bytes, int | None]:
    """(headers with the blank line, payload, page id)."""
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return b"", block, None
    found = re.search(rb"\r\n" + ID_HEADER.encode() + rb": (-?\d+)\r\n", block[: cut + 2])
    return block[: cut + 4], block[cut + 4 :], int(found[1]) if found else None


def warc_record(kind: str, url: str, date: str, own: str, headers: bytes, payload: bytes, refers: str | None = None) -> bytes:
    block = headers + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {iso(date)}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) per record."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"WARC header at byte {at} has no end")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:])}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} is cut short")
        yield head, block
        at = end + 8 + size


# files


def write_archives(archives: DataFrame, what: str) -> str:
    """Writes each value of the binary column ``archive``, which ends in a line feed, as a file; the path."""
    path = new_path(archives.sparkSession, what)
    line = F.expr("substring(archive, 1, octet_length(archive) - 1)").cast("string").alias("value")
    archives.select(line).write.options(lineSep="\n", compression="gzip", maxRecordsPerFile=1, **{"zlib.compress.level": "BEST_SPEED"}).text(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def cut_archives(records: Iterator[bytes], head: bytes = b"") -> Iterator[pd.DataFrame]:
    """Archives of about FILE_BYTES from records, each opened by ``head``."""
    part, size = [head], 0
    for r in records:
        part.append(r)
        size += len(r)
        if size >= FILE_BYTES:
            yield pd.DataFrame({"archive": [b"".join(part)]})
            part, size = [head], 0
    if size:
        yield pd.DataFrame({"archive": [b"".join(part)]})


def number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def write_arc(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "20260101000000") -> str:
    """``pages`` as ARC files, of version 1 and 2 by partition; the path."""
    # ids come as text: pandas would turn longs with nulls into floats
    rows = pages.select(F.col(page_id).cast("long").cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).cast("binary").alias("payload"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        version, name = 1 + n % 2, f"tessera-{n:05d}.arc"
        rows = (r for b in batches for r in zip(b["page_id"], b["url"], b["payload"]))
        yield from cut_archives((arc_record(version, quoted(u), date, http_block(bytes(p or b""), number(i)), name) for i, u, p in rows), arc_version_block(version, name, date))

    return write_archives(rows.mapInPandas(of, "archive binary"), "arc")


ARC_SCHEMA = "file string, offset long, version int, url string, date string, page_id long, headers binary, payload binary, digest string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, version, url, date, page_id, headers, payload, digest) per URL record."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                yield from framed(((name, r["offset"], r["version"], r["url"], r["date"], page, headers, payload, digest(payload)) for r in parse_arc(plain(bytes(content))) for headers, payload, page in [split_http(r["block"])]), ARC_SCHEMA)

    return read_files(spark, path).mapInPandas(of, ARC_SCHEMA)


def plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def framed(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Frames of at most 500 rows, with nulls in whole numbers."""
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    while part := list(islice(rows, 500)):
        yield pd.DataFrame({n: pd.array(list(x), "Int64") if t in ("long", "int") else pd.Series(x, dtype=object) for n, t, x in zip(names, types, zip(*part))})


def convert(spark: SparkSession, arc_path: str, min_bytes: int = 0) -> str:
    """ARC files to WARC files; the path.  Payloads of at least ``min_bytes`` that are equal share one response:
    that of the largest page id, of equal ids the last by file and offset.

    The archives are read once for the digests alone and once to convert them, so payloads are neither stored nor
    dealt out on the way to the digests; only digests that repeat are joined back.
    """
    records = read_arc(spark, arc_path)
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("page"), F.col("file"), F.col("offset"), F.col("url"), F.col("date"))
    shared = records.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max(rank).alias("best"), F.count("digest").alias("n"))
    best = store(shared.filter("n > 1").drop("n"), "responses")
    marked = records.join(best, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "date", "headers", "payload", "digest",
        F.coalesce(rank != F.col("best"), F.lit(False)).alias("again"),
        F.col("best.page").cast("string").alias("first_page"), F.col("best.url").alias("first_url"), F.col("best.date").alias("first_date"),
    )

    def one(page, url, date, headers, payload, sha, again, p1, u1, d1) -> bytes:
        refers = record_id(number(p1), sha, u1, d1) if again else None
        return warc_record("revisit" if again else "response", url, date, record_id(number(page), sha, url, date), bytes(headers), bytes(payload), refers)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from cut_archives(one(*r) for b in batches for r in b.itertuples(index=False))

    return write_archives(marked.mapInPandas(of, "archive binary"), "warc")


WARC_SCHEMA = "record_id string, page_id long, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, record_type, url, date, payload_bytes, payload_digest, refers_to, payload) per record, digests and lengths checked."""

    def one(head: dict[str, str], block: bytes) -> tuple:
        own, sha, size = head["warc-record-id"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
        payload = split_http(block)[1] if head["warc-type"] == "response" else None
        if head["warc-block-digest"] != "sha1:" + digest(block) or payload is not None and (digest(payload) != sha or len(payload) != size):
            raise ValueError(f"{own}: the record isn't what its digests say")
        return own, page_of(own), head["warc-type"], head["warc-target-uri"], head["warc-date"], size, sha, head.get("warc-refers-to"), payload

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield from framed((one(*r) for r in parse_warc(plain(bytes(content)))), WARC_SCHEMA)

    return read_files(spark, path).mapInPandas(of, WARC_SCHEMA)


def page_in(urn: str) -> Column:
    """The page id in a URN column, as ``page_of`` has it."""
    s = F.regexp_replace(F.regexp_replace(F.col(urn), "^<urn:uuid:|>$", ""), "-", "")
    top, high, low = (F.conv(F.substring(s, at, n), 16, 10).cast("long") for at, n in ((16, 1), (17, 8), (25, 8)))
    bits = F.shiftleft(top, 62).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit((1 << 30) - 1)), 32)).bitwiseOR(low)
    return F.when(F.substring(s, 13, 1) == "8", bits)
