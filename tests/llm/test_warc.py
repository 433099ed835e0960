from __future__ import annotations

import hashlib

import pytest

from quillmark.llm import warc
from quillmark.llm.common import remove_path, scratch_path
from tests.compare import assert_same, connection


def test_query_agrees_with_sql(spark, sf):
    from quillmark.llm.queries import ORACLE_SQL

    assert assert_same(warc.op5_warc(spark, sf), connection(sf), ORACLE_SQL["op5_warc"]) > 0


MAGIC = warc.MAGIC
FAKE = f"{MAGIC}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/\r\nX-Bad: 1", "<p>short</p>"), (2, None, None), (3, "http://c", ""), (4, "http://d", "x" * 100), (5, "http://e", "x" * 100), (6, None, "x" * 99), (7, "u", "x" * 99),
        (8, "http://fake", f"before {FAKE} after"), (9, "http://fake2", FAKE * 30), (10, "http://f", MAGIC), (11, "é", "ü東\U0001f600" * 50), (12, "same fake", f"before {FAKE} after"),
        (13, "end", "ends with a magic " + MAGIC + "WARC-Type: response\r\nContent-Length: 0\r\n\r\n"), (14, "long", "y" * 3_000_000), (15, "break", "\r\n\r\n" * 60), (16, "http", "HTTP/1.1 200 OK\r\n\r\nbody " * 9),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(pages) -> set:
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in sorted(rows):
        first.setdefault(b, i)
    out = set()
    for i, b in rows:
        again = len(b) >= 100 and first[b] != i
        out.add((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return out


def test_round_trip_with_magic_inside_payloads(pages):
    got = warc.round_trip(pages).collect()
    assert {tuple(r) for r in got} == expected(pages) and len(got) == pages.count()


def test_many_repeated_digests_give_the_same_revisits(pages):
    rows = lambda df: sorted(df.select("page_id", "record_type", "refers_to", "digest").collect(), key=str)
    assert rows(warc.with_revisits(pages)) == rows(warc.with_revisits(pages, broadcast=0))


def test_archives_split_anywhere_give_the_same_records(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages.where("page_id < 14").coalesce(1), path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    seen = []
    for size in ("128m", "997b", "331b"):
        spark.conf.set(key, size)
        seen.append(sorted((r.page_id, r.record_type, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, path).collect()))
    spark.conf.set(key, before)
    remove_path(spark, path)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 13
    bodies = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert all(d == hashlib.sha256(bodies[i]).hexdigest() for i, kind, _, d in seen[0] if kind == "response")


def test_reachable_follows_the_chain_only(spark):
    edges = [("f", 0, 10), ("f", 10, 25), ("f", 12, 18), ("f", 18, 25), ("f", 25, 40), ("g", 5, 9), ("h", 0, 7)] + [("long", i, i + 1) for i in range(70)]
    df = spark.createDataFrame(edges, "file string, off long, next long")
    got = {tuple(r) for r in warc.reachable(df).collect()}
    assert got == {("f", 0), ("f", 10), ("f", 25), ("h", 0)} | {("long", i) for i in range(70)}
    assert warc.reachable(df.limit(0)).count() == 0


def test_empty_table_and_repeated_pages(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = pages.where("page_id in (4, 5)").unionByName(pages.where("page_id in (4, 5)"))
    got = warc.round_trip(twice).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(4, "response"), (4, "response"), (5, "revisit"), (5, "revisit")]
    assert {r.payload_bytes for r in got} == {100}
    no_id = spark.createDataFrame([(None, "u", "z" * 200), (3, "v", "z" * 200), (4, "w", "z" * 200)], "page_id long, url string, html string")
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.round_trip(no_id).collect()) == [(-1, "revisit", 3), (3, "response", None), (4, "revisit", 3)]


def test_ids_of_any_type_and_many_named_responses(spark, pages):
    from pyspark.sql import functions as F

    name = F.when(F.col("page_id") == 4, "0 ä+%\r\nX-Page-Id: 7").when(F.col("page_id") == 8, "").otherwise(F.concat(F.lit("a"), F.col("page_id").cast("string")))
    clash = {c: F.lit(c) for c in ("digest", "first", "record_type", "_qm_salt", "_qm_payload", "file", "off")}
    named = pages.withColumn("page_id", name).withColumns(clash)
    for broadcast in (warc.BROADCAST_DIGESTS, 0):
        got = warc.round_trip(named, broadcast).collect()
        assert {tuple(r) for r in got} == expected(named) and len(got) == named.count()
    whole = warc.round_trip(pages, 0).collect()
    assert {tuple(r) for r in whole} == expected(pages)
    for kind in ("int", "decimal(20,0)", "date"):
        one = pages.where("page_id in (4, 5)").withColumn("page_id", F.expr("date '2020-01-01' + int(page_id)") if kind == "date" else F.col("page_id").cast(kind))
        assert {tuple(r) for r in warc.round_trip(one).collect()} == expected(one)
