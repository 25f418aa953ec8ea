import base64
import glob
import hashlib
import os

import pytest
from oracle import compare, connect

from tagloom.llm import warc
from tagloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
DATE = "2024-05-06T07:08:09Z"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def by_hand(rows):
    payloads = [(i, (t or "").encode()) for i, _, t in rows]
    out = []
    for i, p in payloads:
        first = max(j for j, q in payloads if q == p)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out)


def columns(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def files(folder):
    return [open(f, "rb").read() for f in glob.glob(os.path.join(folder.removeprefix("file:"), "part-*")) if os.path.getsize(f)]


ROWS = (
    [(k, f"http://a.example/{k}", f"<p>page {k % 7}</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * (k % 3)) for k in range(60)]
    + [(100 + k, f"http://b.example/é {k}\r\nX: y", None if k % 2 else "") for k in range(30)]
    + [(200, None, warc.SEPARATOR * 3), (201, "http://c.example/", "long é " * 100_000), (202, "u", "�\x00")]
)


def test_whole_table_against_sql(spark):
    assert compare("op12", QUERIES["op12_warc_revisits"](spark, SF), connect(SF), ORACLES["op12_warc_revisits"]) is None


def test_copies_against_sql_and_by_hand(spark, tmp_path):
    import duckdb

    df = frame(spark, ROWS)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ROWS)
    found = warc.archive_pages(df, date=DATE, folder=str(tmp_path / "a")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert columns(found) == by_hand(ROWS)
    assert compare("copies", found, con, ORACLES["op12_warc_revisits"]) is None


def test_archives_are_plain_warc(spark, tmp_path):
    """Any reader that unpacks the files and goes by the lengths gets every record, and references hold."""
    headers = warc.archive_pages(frame(spark, ROWS).repartition(3), date=DATE, folder=str(tmp_path))
    assert headers.where("NOT whole").count() == 0
    crawl = [r for data in files(f"{tmp_path}/crawl") for r in warc.unpack(data)]
    assert sorted((h["page_id"], p) for h, p in crawl) == sorted((i, (t or "").encode()) for i, _, t in ROWS)
    kept = [r for data in files(f"{tmp_path}/deduplicated") for r in warc.unpack(data)]
    assert len(kept) == len(ROWS) and len({h["record_id"] for h, _ in kept}) == len(ROWS)
    originals = {h["record_id"]: (h, p) for h, p in kept if h["record_type"] == "response"}
    html = {i: (t or "").encode() for i, _, t in ROWS}
    for h, p in kept:
        assert h["date"] == DATE
        if h["record_type"] == "revisit":
            first, payload = originals[h["refers_to_id"]]
            assert p == b"" and payload == html[h["page_id"]] and first["page_id"] == h["refers_to"] > h["page_id"]
        else:
            assert p == html[h["page_id"]]
    assert len(originals) == len(set(html.values()))


def test_small_files_are_split(spark, tmp_path):
    """A file read by many tasks gives the same records."""
    warc.write_archive(frame(spark, ROWS).coalesce(1), f"{tmp_path}/one", DATE)
    want = sorted((r.page_id, r.payload_digest) for r in warc.read_headers(spark, f"{tmp_path}/one").collect())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (97, 700, 1500):
            for k in old:
                spark.conf.set(k, str(size))
            found = warc.read_headers(spark, f"{tmp_path}/one")
            assert found.rdd.getNumPartitions() > 3
            assert sorted((r.page_id, r.payload_digest) for r in found.collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_least_bytes_and_hot_digests(spark, tmp_path, monkeypatch):
    rows = [(k, "u", "" if k % 3 else f"page {k // 6}") for k in range(90)]
    want = by_hand(rows)
    for share in (1, 1000):
        monkeypatch.setattr(warc, "HOT_SHARE", share)
        assert columns(warc.archive_pages(frame(spark, rows), folder=f"{tmp_path}/{share}")) == want
    some = warc.archive_pages(frame(spark, rows), least_bytes=1, folder=f"{tmp_path}/some")
    assert columns(some) == sorted(r if r[1] else (*r[:3], "response", None) for r in want)


def test_edges(spark, tmp_path):
    rows = [(None, "a", "x"), (None, "b", "x"), (5, None, "x"), (7, "c", "y"), (7, "c", "y"), (8, "", None)]
    df = frame(spark, rows).selectExpr("*", "1 AS member", "2 AS record_id", "3 AS uri")
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to or 0) for r in warc.archive_pages(df, folder=f"{tmp_path}/e").collect())
    assert got == [(0, "revisit", 5), (0, "revisit", 5), (5, "response", 0), (7, "response", 0), (7, "revisit", 7), (8, "response", 0)]
    assert warc.archive_pages(df.limit(0), folder=f"{tmp_path}/none").collect() == []


def test_member_hides_the_closing_member():
    data = os.urandom(3000) + warc.CLOSE + os.urandom(3000)
    packed = warc.member(data)
    assert warc.CLOSE not in packed and warc.zlib.decompress(packed, 31) == data
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
