"""WARC archives: write, read back, resolve revisits, and write deduplicated archives.

An archive is a folder of gzip files, one written by each task. A record is one gzip member (WARC header, HTTP
header and payload) and a second, constant member holds the two line ends that close it. So the unpacked
bytes are plain WARC/1.1, every record can be read from its own offset, and Spark's text reader splits the
files at the constant member: a row is a record, and large files are read by several tasks. Files are written
by Spark's own writer, so they reach any file system it does, and a lost task leaves nothing behind.

Revisits are found by shuffling headers alone: the digest, length and id of every record, with one original
for each digest. Payloads move once, to meet the decision on their record.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom.llm.common import batch, map_arrow
from tagloom.sources.staging import shared_folder, stage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A digest with a thousandth of all records is hot; there are at most a thousand such, so they are broadcast.
HOT_SHARE = 1000
HEADERS = (
    "record_id string, page_id long, record_type string, uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to_id string, refers_to long, whole boolean"
)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pack(pieces: list[bytes], level: int = 4) -> bytes:
    """One gzip member; a flush parts the pieces, so that bytes stored as they are never span two of them."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = [pack.compress(pieces[0])]
    for piece in pieces[1:]:
        out += [pack.flush(zlib.Z_SYNC_FLUSH), pack.compress(piece)]
    return b"".join([*out, pack.flush()])


#: The member that closes a record, as the text writer's line separator (one byte a character).
CLOSE = _pack([b"\r\n\r\n"])
SEPARATOR = CLOSE.decode("latin-1")


def member(data: bytes) -> bytes:
    """``data`` as a gzip member in which the closing member does not occur, not even where bytes are stored."""
    half = len(CLOSE) // 2
    first, *rest = data.split(CLOSE)
    cut = [first]
    for piece in rest:
        cut[-1] += CLOSE[:half]
        cut.append(CLOSE[half:] + piece)
    for level in (4, 9, 1):
        packed = _pack(cut, level)
        if CLOSE not in packed:
            return packed
    raise ValueError("the closing member occurs in a record however it is packed")


def _line(name: str, value) -> str:
    # A header field is one line.
    return f"{name}: {' '.join(str(value).split())}\r\n" if value not in (None, "") else ""


def response(page_id, uri, record_id: str, payload: bytes, date: str, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A response record: WARC header, HTTP header and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = (
        "WARC/1.1\r\nWARC-Type: response\r\n" + _line("WARC-Record-ID", f"<{record_id}>") + _line("WARC-Date", date)
        + _line("WARC-Target-URI", uri) + _line("WARC-Payload-Digest", f"sha1:{digest(payload)}") + _line("Page-ID", page_id)
        + "Content-Type: application/http; msgtype=response\r\n" + f"Content-Length: {len(http) + len(payload)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + http + payload


def revisit(h: dict, record_id: str, original: dict, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A revisit record of the record with headers ``h``: it names the original and keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {h['payload_bytes']}\r\n\r\n".encode()
    head = (
        "WARC/1.1\r\nWARC-Type: revisit\r\n" + _line("WARC-Record-ID", f"<{record_id}>") + _line("WARC-Date", h["date"])
        + _line("WARC-Target-URI", h["uri"]) + _line("WARC-Payload-Digest", f"sha1:{h['payload_digest']}") + _line("Page-ID", h["page_id"])
        + _line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<{original['record_id']}>")
        + _line("WARC-Refers-To-Target-URI", original["uri"]) + _line("WARC-Refers-To-Date", original["date"])
        + _line("Refers-To-Page-ID", original["page_id"])
        + "Content-Type: application/http; msgtype=response\r\n" + f"Content-Length: {len(http)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + http


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers and payload of one unpacked record; ``whole`` says whether lengths and digest agree with it."""
    cut = data.index(b"\r\n\r\n") + 4
    lines = data[:cut].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:] if x)
    body = data.index(b"\r\n\r\n", cut) + 4
    http = dict(x.split(": ", 1) for x in data[cut:body].decode().split("\r\n")[1:] if x)
    payload, n = data[body:], int(http["Content-Length"])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    whole = int(fields["Content-Length"]) == len(data) - cut
    whole = whole and (not payload if kind == "revisit" else len(payload) == n and digest(payload) == named)
    number = lambda x: None if x is None else int(x)
    return {
        "record_id": fields["WARC-Record-ID"][1:-1], "page_id": number(fields.get("Page-ID")), "record_type": kind,
        "uri": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"], "payload_digest": named, "payload_bytes": n,
        "refers_to_id": fields["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in fields else None,
        "refers_to": number(fields.get("Refers-To-Page-ID")), "whole": whole,
    }, payload


def _write(members: DataFrame, path: str) -> None:
    """``members`` has one column of gzip members; a file is one partition's, closed by the constant member each."""
    text = members.select(F.col(members.columns[0]).cast("string").alias("value"))
    text.write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(path)


def _members(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(path)
    return read.select(F.col("value").cast("binary").alias("member"))


def _slices(batches, most: int = 16_000_000):
    """Lists of rows of about ``most`` bytes (one row more at most), so that a task holds little."""
    for b in batches:
        rows, held = [], 0
        for k in range(b.num_rows):
            rows.append(tuple(c[k].as_py() for c in b.columns))
            held += len(rows[-1][-1] or b"")
            if held >= most or len(rows) >= 1000:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


def write_archive(pages: DataFrame, path: str, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a response record for every row of ``pages``; the payload is the html in UTF-8 (null: empty)."""
    read = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("uri"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"),
    )

    def make():
        schema = pa.schema([("member", pa.binary())])

        def run(batches):
            for rows in _slices(batches):
                yield batch(schema, member=[member(response(i, u, uuid.uuid4().urn, p, date)) for i, u, p in rows])

        return run

    _write(map_arrow(read, make, "member binary"), path)


def read_headers(spark: SparkSession, path: str, schema: str = HEADERS) -> DataFrame:
    """The headers of an archive's records, each unpacked and checked against its payload (``whole``)."""

    def make():
        names = [f.split()[0] for f in schema.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        fields = pa.schema([(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")])

        def run(batches):
            for rows in _slices(batches):
                found = [parse(zlib.decompress(m, 31))[0] for (m,) in rows]
                yield batch(fields, **{n: [h[n] for h in found] for n in names})

        return run

    return map_arrow(_members(spark, path), make, schema)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records that revisit another, with its headers under ``original``: record_id, original.

    Of records with one payload digest, and at least ``least_bytes``, that with the largest page_id (null ids are
    the smallest, ties go to the larger record_id) is the original. Only headers are shuffled, and minima are
    combined before that. Records meet their original by the digest; digests that hold a thousandth of all
    records or more, of which there are at most a thousand, are broadcast instead, so no task gets a hot one.
    """
    known = headers.where(F.col("payload_bytes") >= least_bytes)
    original = F.struct("record_id", "page_id", "uri", "date")
    place = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record_id")
    groups = known.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max_by(original, place).alias("original"))
    groups = stage(groups.where("n > 1"))
    total = headers.count()
    hot = groups.where(F.col("n") * HOT_SHARE >= total).drop("n")
    cold = groups.where(F.col("n") * HOT_SHARE < total).drop("n")
    mine = known.select("record_id", "payload_digest")
    by_hot = mine.join(F.broadcast(hot), "payload_digest")
    names = [r.payload_digest for r in hot.select("payload_digest").collect()]
    by_cold = mine.where(~F.col("payload_digest").isin(names)).join(cold, "payload_digest")
    found = by_hot.unionByName(by_cold)
    return found.where(F.col("record_id") != F.col("original.record_id")).select("record_id", "original")


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = 0) -> None:
    """Reads the archive ``source`` and writes ``target``, in which repeated payloads are revisit records.

    Every record gets a fresh header; a response that others refer to keeps its record id, so that the references
    hold. Records meet their decision by record id, which is unique.
    """

    def keyed():
        schema = pa.schema([("record_id", pa.string()), ("member", pa.binary())])

        def run(batches):
            for rows in _slices(batches):
                packed = [m for (m,) in rows]
                # The WARC header is at the front; the payload need not be unpacked for the id.
                heads = [zlib.decompressobj(31).decompress(m, 400) for m in packed]
                ids = [h[h.index(b"WARC-Record-ID: <") + 17 :].split(b">", 1)[0].decode() for h in heads]
                yield batch(schema, record_id=ids, member=packed)

        return run

    def fresh():
        schema = pa.schema([("member", pa.binary())])

        def one(packed, original):
            h, payload = parse(zlib.decompress(packed, 31))
            if original is not None:
                return member(revisit(h, uuid.uuid4().urn, original))
            return member(response(h["page_id"], h["uri"], h["record_id"], payload, h["date"]))

        def run(batches):
            for rows in _slices(batches):
                yield batch(schema, member=[one(m, o) for o, m in rows])

        return run

    headers = stage(read_headers(spark, source))
    decisions = stage(resolve_revisits(headers, least_bytes))
    records = map_arrow(_members(spark, source), keyed, "record_id string, member binary")
    decided = records.join(decisions, "record_id", "left").select("original", "member")
    _write(map_arrow(decided, fresh, "member binary"), target)


def archive_pages(pages: DataFrame, least_bytes: int = 0, date: str | None = None, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes ``pages`` as an archive, deduplicates it into a second one and returns the headers read back from that.

    One row per row of ``pages`` with the columns of ``HEADERS``: payload_bytes and payload_digest are those of the
    full payload, record_type is response or revisit, refers_to the page_id of the response that a revisit names.
    The archives are ``folder``/crawl and ``folder``/deduplicated (by default a new folder in the shared one) and
    stay there. ``date`` (the same for all) is the time of the call if not given.

    Null html is an empty payload, empty payloads revisit each other like any; null page ids are kept and never
    preferred as an original; of rows that share the id and the payload one is the original. An empty table
    gives empty archives. Other columns are not read (``columns`` may rename id_col, url_col, html_col).
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    write_archive(pages, f"{folder}/crawl", date, **columns)
    deduplicate(spark, f"{folder}/crawl", f"{folder}/deduplicated", least_bytes)
    return read_headers(spark, f"{folder}/deduplicated")


def unpack(data: bytes) -> list[tuple[dict, bytes]]:
    """Headers and payloads of a whole archive file, by the lengths alone, as any WARC reader would."""
    import gzip

    out, stream = [], io.BytesIO(gzip.decompress(data))
    while head := stream.readline():
        fields = [head]
        while (line := stream.readline()) != b"\r\n":
            fields.append(line)
        n = next(int(f.split(b":")[1]) for f in fields if f.lower().startswith(b"content-length:"))
        out.append(parse(b"".join(fields) + b"\r\n" + stream.read(n)))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is not closed")
    return out


#: The contract's rows in DuckDB's SQL; base32 is read off the hexadecimal digits, five digits to four letters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 5 * CAST(k // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""
