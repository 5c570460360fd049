import base64
import gzip
import hashlib

import pytest

from tessera.llm import queries, warc


def sha(p):
    return base64.b32encode(hashlib.sha1(p).digest()).decode()


def brute(rows):
    """From (page_id, payload): what the contract says, ids distinct or null."""
    best = {}
    for i, p in rows:
        best[p] = max(best.get(p, (False, 0)), (i is not None, i or 0))
    out = []
    for i, p in rows:
        first = best[p] == (i is not None, i or 0)
        out.append((i, len(p), sha(p), "response" if first else "revisit", None if first else best[p][1] if best[p][0] else None))
    return sorted(out, key=str)


def test_arc_versions_and_lengths():
    url = "http://a.example/x"
    for version in (1, 2):
        tricky = warc.http_block(b"\nhttp://b.example/ 0.0.0.0 2026 text/html 5\nWARC/1.1\r\n\r\n", -5)
        data = warc.arc_version_block(version, "f.arc", "20260101000000") + warc.arc_record(version, url, "20251231", tricky) + warc.arc_record(version, "http://b.example/a b", "bad", b"")
        a, b = warc.parse_arc(data)
        assert (a["version"], a["url"], a["block"], a["date"]) == (version, url, tricky, "20251231")
        assert b["url"] == "http://b.example/a b" and b["block"] == b""
        assert warc.split_http(tricky)[1:] == (tricky.partition(b"\r\n\r\n")[2], -5)
        for cut in (data[:-5], data[:-2] + b"x", b"http://a 0 0 t 3\nabc"):
            if cut != data[:-5] or version:
                with pytest.raises(ValueError):
                    list(warc.parse_arc(cut)) if cut[:4] == b"http" else list(warc.parse_arc(data[: data.rindex(b"HTTP") + 5]))


def test_dates():
    assert warc.iso("20251231235958") == "2025-12-31T23:59:58Z" and warc.iso("2025") == "2025-01-01T00:00:00Z" and warc.iso("20259999") == "1970-01-01T00:00:00Z"


def test_ids_carry_pages():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 2**62, 12345):
        assert warc.page_of(warc.record_id(i, "D", "u", "d")) == i
    assert warc.page_of(warc.record_id(None, "D", "u", "d")) is None and warc.page_of(None) is None


def test_warc_record_is_parsed_by_length():
    p = b"x\r\n\r\nWARC/1.1\r\n" * 3
    (h, b), (h2, b2) = warc.parse_warc(warc.warc_record("response", "u", "2025", "<urn:uuid:1>", b"", p) + warc.warc_record("revisit", "u", "2025", "<urn:uuid:2>", b"H\r\n\r\n", p, "<urn:uuid:1>"))
    assert b == p and h["warc-payload-digest"] == "sha1:" + sha(p) and b2 == b"H\r\n\r\n" and h2["warc-refers-to"] == "<urn:uuid:1>"


PAGES = [(1, "http://a/ü x\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (-9, "u", "\r\n\r\n"), (None, "u", "<p>é</p>"), (None, "v", "only null"), (None, "v", "only null"), (2**62 + 5, "w", "z" * 3_000_000), (7, "w", "line\n"), (8, "w", "line\n"), (9, "w", "\x00\x01﻿\U0001f600")]


def through(spark, df):
    return warc.read_warc(spark, warc.convert(spark, warc.write_arc(df)))


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 5, "a") for r in PAGES], "page_id long, url string, html string, digest int, payload string")
    got = through(spark, df).withColumn("page_to", warc.page_in("refers_to")).collect()
    rows = [(i, (h or "").encode()) for i, _, h in PAGES]
    known = [r for r in rows if r[1] != b"only null"]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.page_to) for r in got if r.payload_digest != sha(b"only null")), key=str) == brute(known)
    assert sorted(r.record_type for r in got if r.payload_digest == sha(b"only null")) == ["response", "revisit"]
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {p for _, p in rows}
    assert {r.page_to for r in got} == {warc.page_of(r.refers_to) for r in got}
    assert {r.refers_to for r in got} - {None} <= {r.record_id for r in got if r.record_type == "response"}


def test_repeated_rows_leave_one_response(spark):
    got = through(spark, spark.createDataFrame([(5, "u", "x")] * 4, "page_id long, url string, html string")).collect()
    assert sorted(r.record_type for r in got) == ["response"] + ["revisit"] * 3


def test_empty(spark):
    assert through(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_files_are_archives(spark, tmp_path):
    arc = warc.write_arc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1))
    (name,) = [x for x in __import__("glob").glob(arc.removeprefix("file://") + "/part-*")]
    data = gzip.decompress(open(name, "rb").read())
    assert data.startswith(b"filedesc://") and len(list(warc.parse_arc(data))) == len(PAGES)


def test_query_on_sf001(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op8_warc_from_arc(spark, d).collect()), key=str) == brute(rows)
