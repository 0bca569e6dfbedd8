"""WARC: exact round trips, what is revisited, what a reader skips."""

import gzip
import hashlib
import io
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import queries, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    long = "é" * 80
    rows = [(3, "u3", long), (1, "u\r\n1", long), (2, None, long), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (7, "u7", ""), (None, "n", long), (8, "u8", "x" * 100), (8, "u8", "x" * 100), (9, "u9", "y" * 300_000), (None, "n1", "z" * 200), (None, "n2", "z" * 200)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")


def expected(rows):
    first = {}
    for r in rows:
        h = r["html"] or ""
        if len(h.encode()) >= 100 and r["page_id"] is not None:
            first[h] = min(first.get(h, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        data = (r["html"] or "").encode()
        to = first.get(r["html"] or "")
        again = to is not None and r["page_id"] != to
        out.append((r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    got = warc.archive_and_read(pages)
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages.collect())
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_shuffled_when_there_are_many_groups(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, warc.archive_and_read(pages).collect()), key=str) == expected(pages.collect())


def test_payloads_and_pushdown(spark, pages, tmp_path, capsys):
    path = f"file://{tmp_path}/a"
    warc.archive_pages(pages, path)
    rows = warc.read_warc(spark, path).filter("record_type = 'response' and page_id = 9")
    rows.explain("formatted")
    assert "EqualTo(record_type,response)" in capsys.readouterr().out
    assert bytes(rows.first()["payload"]) == b"y" * 300_000
    assert warc.read_warc(spark, path, payload=False).filter(F.col("payload").isNotNull()).count() == 0
    assert warc.read_warc(spark, path).filter("page_id in (1, 3) and target_uri like 'u%'").count() == 2
    assert warc.read_warc(spark, path).filter("page_id is null").count() == 3


def test_records_that_do_not_pass_are_not_decoded():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    big = os.urandom(500_000)
    records = [{"record_type": "response", "page_id": k} for k in range(3)]
    f = Counting(b"".join(warc._member(warc.record(r, big)) for r in records))
    got = list(warc.read_records(f, lambda h: h["warc-page-id"] == "1", True))
    assert [p for _, p in got] == [big] and Counting.taken < 600_000


def test_foreign_archives():
    rows = [warc.record({"record_type": "response", "page_id": k}, b"p%d" % k) for k in range(3)]
    for data in (b"".join(rows), b"".join(gzip.compress(r) for r in rows)):
        got = list(warc.read_records(io.BufferedReader(io.BytesIO(data)), lambda h: h["warc-page-id"] != "1", True))
        assert [p for _, p in got] == [b"p0", b"p2"]


def test_members_are_plain_gzip():
    assert gzip.decompress(warc._member(b"one") + warc._member(b"two")) == b"onetwo"


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(map(tuple, queries.op4_warc(spark, SF).select(columns).collect()), key=str)
    assert got == sorted(con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL['op4_warc']})").fetchall(), key=str)
