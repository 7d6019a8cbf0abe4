import base64
import gzip
import hashlib
import os

import pytest

from loadlab.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(rows, least=0):
    found, groups = [], {}
    for k, _, html in rows:
        groups.setdefault(html or "", []).append(k)
    for html, keys in groups.items():
        keys.sort(key=lambda k: (k is None, k or 0))
        size = len(html.encode())
        for i, k in enumerate(keys):
            again = i > 0 and size >= least
            found.append((k, size, digest(html), "revisit" if again else "response", keys[0] if again else None))
    return sorted(found, key=str)


ROWS = [
    (5, "http://a/1", "<p>one</p>"), (3, "http://a/2", "<p>one</p>"), (9, "http://b/ü?x= y\r\nWARC-Type: z", "<p>one</p>"),
    (1, "u", None), (2, None, ""), (7, "", "two\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (8, "u", "ends in breaks\r\n"), (10, "u", "\r\n\r\n\r\n"),
    (11, "u", "é" * 70_000 + "\r\n\r\n" * 5000), (None, "u", "<p>none</p>"), (None, "u", "<p>none</p>"), (12, "u", "same"), (12, "u", "same"), (13, "u", "\r"),
]


@pytest.mark.parametrize("least,share", [(0, 1000), (0, 2), (5, 1000)])
def test_pages_written_and_read(spark, monkeypatch, least, share):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA + ", record string, size int").repartition(3)
    got = warc.archived_pages(df, least_bytes=least)
    assert got.dtypes == [
        ("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")
    ]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, least)
    assert warc.archived_pages(df.limit(0)).collect() == []


def test_payloads_joined_by_number(spark, monkeypatch):
    monkeypatch.setattr(warc, "fits_broadcast", lambda *_: False)
    df = spark.createDataFrame(ROWS * 3, SCHEMA)
    assert sorted(map(tuple, warc.archived_pages(df).collect()), key=str) == brute(ROWS * 3)


def test_archive_text_and_second_deduplication(spark, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    warc.deduplicate(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), first, date="2024-05-01T00:00:00Z")
    parts = [p for p in os.listdir(first) if p.endswith(".gz")]
    raw = b"".join(gzip.open(f"{first}/{p}").read() for p in parts)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
    assert raw.count(b"<p>one</p>") == 1 and raw.count(b"WARC-Refers-To: <urn:uuid:") == 5
    assert b"WARC-Target-URI: http://b/\xc3\xbc?x=%20y%0D%0AWARC-Type:%20z\r\n" in raw
    read = warc.read_archives(spark, first)
    rows = {r.key: r for r in read.collect()}
    assert read.count() == len(ROWS) and bytes(rows["11"].payload).decode() == ROWS[8][2] and rows["9"].payload is None
    assert len({r.record_id for r in read.collect()}) == len(ROWS)
    assert all(r.digest == r.declared for r in rows.values() if r.record_type == "response")
    # Archives of archives: responses once more, with fresh headers.
    warc.deduplicate(read.where("record_type = 'response'").withColumn("k", read.key.cast("long")), second, "k", "uri", "payload")
    again = warc.resolve(warc.read_archives(spark, second)).collect()
    assert len(again) == 9 and {r.record_type for r in again} == {"response"}


def test_foreign_archives(spark, tmp_path):
    def record(*lines, block=b""):
        return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = b"\xff\x00\r\n\r\nbinary"
    name = base64.b32encode(hashlib.sha1(body).digest()).decode()
    files = {
        "a": [
            record("WARC-Type: warcinfo", "WARC-Record-ID: <i>", block=b"software: x\r\n"),
            record("WARC-Type: response", "WARC-Record-ID: <r>", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{name}", block=http + body),
            b"no record\r\n\r\n",
            record("WARC-Type: resource", "WARC-Record-ID: <s>", block=b"plain"),
        ],
        "b": [
            record("WARC-Type: revisit", "WARC-Record-ID: <v>", f"WARC-Payload-Digest: sha1:{name}", "Content-Type: application/http", block=http),
            record("WARC-Type: revisit", "WARC-Record-ID: <w>", "WARC-Payload-Digest: sha1:UNKNOWN", "WARC-Refers-To: <r>"),
            record("WARC-Type: revisit", "WARC-Record-ID: <x>", "WARC-Payload-Digest: sha1:UNKNOWN"),
            record("WARC-Type: response", "WARC-Record-ID: <cut>", block=b"cut short")[:-9],
        ],
    }
    for file, records in files.items():
        # A member a record, as most archives have it.
        (tmp_path / f"{file}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    read = warc.read_archives(spark, str(tmp_path))
    payloads = {r.record_id: r.payload for r in read.collect()}
    assert bytes(payloads["<r>"]) == body and bytes(payloads["<s>"]) == b"plain" and "<cut>" not in payloads and payloads["<v>"] is None
    found = {r.record_id: (r.record_type, r.digest, r["size"]) for r in warc.resolve(read).collect()}
    assert found["<v>"] == ("revisit", name, len(body)) and found["<w>"] == ("revisit", "UNKNOWN", len(body))
    assert found["<x>"] == ("revisit", "UNKNOWN", None) and found["<r>"] == ("response", name, len(body))
    assert len(found) == 6
