"""Exact duplicates against a plain grouping, with filters so small that nearly all is a false alarm, and odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from quillmark.llm import exact, queries
from quillmark.llm.common import table
from tests.compare import assert_same, connection


def slow(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for sha, g in groups.items():
        first = min(g)
        for _, none, doc_id, i in g:
            out.append((None if none else doc_id, None if first[1] else first[2], len(g), i == first[3], sha))
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def pairs(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_odd_rows_agree_with_plain_grouping(odd):
    assert found(exact.duplicates(odd)) == slow(pairs(odd))


@pytest.mark.parametrize("copies", [250_000, 0])
def test_full_filters_and_salted_join_change_nothing(spark, odd, monkeypatch, copies):
    monkeypatch.setattr(exact, "GROUPS", copies)
    hot = odd.select("doc_id", "text").union(spark.range(100, 160).selectExpr("id", "case when id % 2 = 0 then 'a hot text' else ' a  hot\ttext' end"))
    assert found(exact.duplicates(hot, bits=64)) == slow(pairs(hot))


def test_filter_misses_no_repeated_hash_and_stays_bounded(spark):
    rows = exact.fingerprints(spark.range(4000).selectExpr("id as doc_id", "cast(id % 3900 as string) as text"))
    bits = exact.filter_bits(4000)
    tested = {r["doc_id"]: r["maybe"] for r in exact.tested(rows, bits).collect()}
    assert all(tested[i] and tested[i + 3900] for i in range(100))
    assert sum(tested.values()) < 210
    assert exact.filter_bits(10**12) == exact.MOST_BITS and exact.filter_bits(0) == exact.LEAST_BITS


def test_deduplicated_keeps_one_row_of_each_group_and_all_columns(odd):
    kept = exact.deduplicated(odd)
    assert kept.columns == odd.columns
    want = sorted((r for r in slow(pairs(odd)) if r[3]), key=str)
    got = sorted(((r[0], hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r[1] or "").encode()).hexdigest()) for r in pairs(kept)), key=str)
    assert got == sorted(((r[0], r[4]) for r in want), key=str)


def test_empty_table(nothing):
    assert exact.duplicates(nothing).count() == 0
    assert exact.deduplicated(nothing).columns == nothing.columns


def test_query_agrees_with_sql(spark, sf):
    n = assert_same(queries.QUERIES["op12_exact"](spark, sf), connection(sf), queries.ORACLE_SQL["op12_exact"])
    assert n == table(spark, sf, "documents").count()
