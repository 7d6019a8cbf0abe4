"""WARC archives without repeated payloads: revisit resolution by payload digest.

Only headers (record number, key, URI, digest, length) are shuffled, by digest.
The record with the smallest key of each payload stays a ``response``; every other
one becomes a ``revisit`` that names it and carries no payload.  Spark's text sink
writes the archives: a record ends in two line breaks, the sink's separator, and
bytes pass through it unchanged.  Files are compressed as a whole, so that a
task reads a file from its start.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadlab.session import fits_broadcast, new_folder, stage

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A payload counts as hot above a thousandth of all records, so that at most a thousand are; their URIs are sent only up to this length.
HOT_SHARE = 1000
HOT_URI_BYTES = 4096
#: Read records are handed on in batches of this many bytes.
BATCH_BYTES = 8 << 20

SAME = ["digest", "check", "size"]


def base32(sha1_hex: Column) -> Column:
    """Forty hexadecimal digits as 32 characters of base 32: five digits are four characters."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """``record, key, uri, payload, size, digest, check`` for every row, staged so that numbers stay.

    A NULL payload is the empty one.  ``digest`` is the payload's SHA-1 in base 32,
    ``check`` a second hash, so that a forged SHA-1 joins nothing.
    """
    content = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(pages[key].alias("key"), pages[uri].cast("string").alias("uri"), content.alias("payload"))
    hashes = [base32(F.sha1("payload")).alias("digest"), F.xxhash64("payload").alias("check")]
    size = F.octet_length("payload").cast("bigint").alias("size")
    return stage(rows.select(F.monotonically_increasing_id().alias("record"), "*", size, *hashes), "captures")


def _with_first(rows: DataFrame, first: DataFrame, total: int) -> DataFrame:
    """Inner join on the payload.  ``first`` has a row per payload, with ``copies``; payloads of many
    rows are sent to all executors, so that their rows stay where they are."""
    small = F.coalesce(F.octet_length("first.uri"), F.lit(0)) <= HOT_URI_BYTES
    hot = first.where((F.col("copies") > total // HOT_SHARE) & (F.col("copies") > 1) & small)
    beside = F.broadcast(hot.drop("copies"))
    rest = first.join(beside.select(*SAME), SAME, "left_anti").drop("copies")
    cold = rows.join(F.broadcast(hot.select(*SAME)), SAME, "left_anti")
    return rows.join(beside, SAME).unionByName(cold.join(rest, SAME))


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``record, refers_record, refers_key, refers_uri`` for every record whose payload another one holds.

    The one referred to has the smallest key (NULL last), among equal keys the smallest record
    number.  Payloads below ``least_bytes`` are never referred to.
    """
    headers = records.select("record", "key", "uri", *SAME).where(F.col("size") >= least_bytes)
    least = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "record", "uri")).alias("first")
    groups = stage(headers.groupBy(*SAME).agg(least, F.count("*").alias("copies")), "payloads")
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    found = _with_first(headers.drop("uri"), groups.where("copies > 1"), total)
    others = found.where(F.col("record") != F.col("first.record"))
    of = {"refers_record": "first.record", "refers_key": "first.key", "refers_uri": "first.uri"}
    return stage(others.select("record", *[F.col(c).alias(name) for name, c in of.items()]), "revisits")


def _record_id(record: str, digest: str, run: str) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(run), record, digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header_value(value: Column, also: str = "") -> Column:
    """Without characters that would end or split a header line: percent-encoded, as are those in ``also``."""
    safe = value
    for c in [*also, *map(chr, range(0x21)), "\x7f"]:
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(value.rlike(rf"[\x00-\x20\x7F{also}]"), safe).otherwise(value)


def write_archives(records: DataFrame, repeated: DataFrame, path: str, date: str | None = None) -> None:
    """One record per row of ``records``: a ``revisit`` if listed in ``repeated``, else a ``response``.

    ``date`` (``2024-05-01T00:00:00Z``) is the time now if not given.  A NULL URI or key has no header.
    ``repeated`` is sent along if it is small; otherwise payloads are joined by record number.
    """
    run = uuid.uuid4().hex
    beside = F.broadcast(repeated) if fits_broadcast(repeated, ["refers_uri"]) else repeated
    rows = records.join(beside, "record", "left")
    again = F.col("refers_record").isNotNull()
    now = F.lit(date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END)
    )
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id("record", "digest", run)),
        line("WARC-Date", now),
        line("WARC-Target-URI", _header_value(F.col("uri"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(again, PROFILE)),
        line("WARC-Refers-To", F.when(again, _record_id("refers_record", "digest", run))),
        line("WARC-Refers-To-Target-URI", F.when(again, _header_value(F.col("refers_uri")))),
        line("WARC-Source-Key", _header_value(F.col("key").cast("string"), also="%")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", length.cast("string")),
    )
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    whole = F.concat(F.concat(header, F.lit(END), http).cast("binary"), body).cast("string")
    rows.select(whole.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _File:
    """The bytes of one archive as they come, and the records cut out of them."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.header: dict[str, str] | None = None
        self.needed = 0

    def add(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        self.held += END.encode()
        while True:
            if self.header is None:
                start = len(self.held) - len(self.held.lstrip(b"\r\n"))
                stop = self.held.find(b"\r\n\r\n", start)
                if stop < 0:
                    return
                lines = self.held[start:stop].decode("utf-8", "replace").split("\r\n")
                del self.held[: stop + 4]
                fields = dict(f.split(":", 1) for f in lines[1:] if ":" in f)
                header = {name.strip().lower(): value.strip() for name, value in fields.items()}
                size = header.get("content-length", "")
                if not lines[0].startswith("WARC/") or not (size.isascii() and size.isdigit()):
                    continue  # no record: goes on behind the next empty line
                self.header, self.needed = header, int(size)
            if len(self.held) < self.needed + 4:
                return
            block, header = bytes(self.held[: self.needed]), self.header
            del self.held[: self.needed + 4]
            self.header = None
            yield header, block


def _read(with_payload: bool):
    names = ["record_id", "record_type", "uri", "key", "declared", "digest", "size", "refers_to"]
    schema = pa.schema([(n, pa.int64() if n == "size" else pa.string()) for n in names] + [("payload", pa.binary())] * with_payload)

    def row(header: dict[str, str], block: bytes) -> dict:
        if header.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        kind = header.get("warc-type")
        held = kind != "revisit"
        return {
            "record_id": header.get("warc-record-id"), "record_type": kind, "uri": header.get("warc-target-uri"),
            "key": None if (key := header.get("warc-source-key")) is None else unquote(key), "declared": header.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "digest": base64.b32encode(hashlib.sha1(block).digest()).decode() if held else None,
            "size": len(block) if held else None, "refers_to": header.get("warc-refers-to"), "payload": block if held else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, rows, size = None, _File(), [], 0
        for batch in batches:
            for path, piece in zip(batch.column("file").to_pylist(), batch.column("piece")):
                if path != name:
                    name, file = path, _File()
                for header, block in file.add(piece.as_py()):
                    rows.append(row(header, block))
                    size += len(block) * with_payload + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per record of gzip-compressed archives.

    ``record_id, record_type, uri, key, declared`` (the header's digest), ``refers_to`` (a record id),
    and, of what is no revisit, ``digest`` and ``size`` of the payload as read and ``payload`` itself if wanted.
    Whatever is no record, and a last record that ends early, is passed over.
    """
    pieces = spark.read.option("lineSep", END).text(path)
    of_file = pieces.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    columns = "record_id string, record_type string, uri string, key string, declared string, digest string, size bigint, refers_to string"
    return of_file.mapInArrow(_read(payload), columns + ", payload binary" * payload)


def resolve(archived: DataFrame) -> DataFrame:
    """Read records with what their payload is: ``record_id, record_type, key, uri, digest, size, refers_key``.

    A revisit gets digest, length and key of the original response, joined by payload digest;
    without one (its archive is not among those read) only its declared digest.
    """
    archived = stage(archived.drop("payload"), "headers")
    plain = ["record_id", "record_type", "key", "uri"]
    again = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    responses = archived.where(F.col("record_type") == "response")
    repeats = archived.where(again).withColumns({c: F.coalesce(c, F.lit("")) for c in ("declared", "refers_to")})
    # A row per payload that is referred to.
    copies = stage(repeats.groupBy("declared", "refers_to").agg(F.count("*").alias("copies")), "referred")
    by_id = responses.select(F.col("record_id").alias("refers_to"), F.struct("key", "size").alias("named"))
    least = F.min(F.struct("record_id", "key", "size")).alias("same")
    by_digest = responses.groupBy(F.col("digest").alias("declared")).agg(least)
    found = copies.join(by_id, "refers_to", "left").join(by_digest, "declared", "left")
    named = F.col("named").isNotNull()
    original = [
        F.when(named, F.col(f"named.{c}")).otherwise(F.col(f"same.{c}")).alias(f"found_{c}") for c in ("key", "size")
    ]
    found = stage(found.select("declared", "refers_to", "copies", *original), "originals")
    # Payloads of many revisits are sent to all executors, so that a hot one is not one task's.
    total = copies.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    small = F.coalesce(F.octet_length("found_key"), F.lit(0)) + F.octet_length("declared") + F.octet_length("refers_to") <= HOT_URI_BYTES
    is_hot = (F.col("copies") > total // HOT_SHARE) & (F.col("copies") > 1) & small
    on = ["declared", "refers_to"]
    hot = F.broadcast(found.where(is_hot).drop("copies"))
    rest = repeats.join(hot.select(*on), on, "left_anti").join(found.where(~is_hot).drop("copies"), on)
    joined = repeats.join(hot, on).unionByName(rest)
    declared = F.nullif("declared", F.lit(""))
    resolved = joined.select(*plain, declared.alias("digest"), F.col("found_size").alias("size"), F.col("found_key").alias("refers_key"))
    others = archived.where(~again).select(*plain, "digest", "size", F.lit(None).cast("string").alias("refers_key"))
    return others.unionByName(resolved)


def deduplicate(
    pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, date: str | None = None
) -> None:
    """Write the rows of ``pages`` as archives below ``path`` that hold each payload once.

    Pages read by ``read_archives`` (``key="key", uri="uri", payload="payload"``) give deduplicated copies of
    archives with fresh headers.  Repeated rows are records of their own, all but one of them revisits; NULL and empty
    payloads are equal; an empty table gives no record; other columns are not read.
    """
    records = captures(pages, key, uri, payload)
    write_archives(records, revisits(records, least_bytes), path, date)


def archived_pages(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages written as deduplicated archives in the shared folder and read back.

    ``key, payload_bytes, payload_digest, record_type, refers_to`` (the key of the response a
    revisit refers to), a row per page.  Lengths and digests of responses are computed from the bytes read.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "archives")
    deduplicate(pages, path, key, uri, payload, least_bytes)
    kind = pages.schema[key].dataType
    found = resolve(read_archives(spark, path, payload=False))
    return found.select(
        F.col("key").cast(kind).alias(key), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers_key").cast(kind).alias("refers_to"),
    )
