"""Importance resampling against plain loops over every feature."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillmark.llm import queries, resampling
from quillmark.llm.common import table
from tests.compare import assert_same, connection


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text: str | None) -> list[int]:
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def slow(docs: list[tuple], target: list[str | None]) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    s_all, t_all = s.total(), t.total()
    rows = []
    for doc_id, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_agrees_with_plain_loops(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, sf, "benchmark").select("text").collect()]
    assert found(queries.QUERIES["op11_resampling"](spark, sf)) == slow(docs, target)


@pytest.mark.parametrize("block", [40, resampling.BLOCK])
def test_odd_rows_and_texts_longer_than_a_block(spark, odd, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling.pieces, "__defaults__", (block,))
    monkeypatch.setattr(resampling, "SLICE", 4 * block)
    target = spark.createDataFrame([("the of and to in that",), (None,), ("",)], "text string")
    many = odd.select("doc_id", "text").union(spark.range(100, 200).selectExpr("id", "concat('the of and ', repeat(concat('w', id % 7, ' '), 30))"))
    assert found(resampling.resampling(many, target)) == slow([tuple(r) for r in many.collect()], ["the of and to in that", None, ""])


def test_blocks_are_cut_in_tasks_as_well(spark, monkeypatch):
    """The functions that run in tasks, here with tiny blocks, since a patch does not reach a worker."""
    import pyarrow as pa

    monkeypatch.setattr(resampling, "BLOCK", 30)
    monkeypatch.setattr(resampling.pieces, "__defaults__", (30,))
    monkeypatch.setattr(resampling, "SLICE", 64)
    texts = [" ".join(f"W{(i * j) % 11}é" for j in range(i * 9)) for i in range(25)] + ["", "…"]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts])], names=["b"])
    (out,) = resampling._counted(10_000)(iter([batch]))
    assert dict(zip(*(c.to_pylist() for c in out.columns), strict=True)) == Counter(b for t in texts for b in features(t))
    gain = np.random.default_rng(1).integers(-3000, 3000, 10_000)
    rows = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(range(len(texts))), batch.column(0)], names=["_qm_id", "doc_id", "b"])
    (out,) = resampling._scored(gain, 42)(iter([rows]))
    assert out.column("weight").to_pylist() == [sum(int(gain[b]) for b in features(t)) for t in texts]


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=20), st.lists(st.binary(max_size=300), min_size=1, max_size=20))
def test_joined_hashes(a, b):
    n = min(len(a), len(b))
    of = lambda x: np.array([zlib.crc32(y) for y in x[:n]], np.uint32)
    joined = resampling.crc_joined(of(a), of(b), np.array([len(y) for y in b[:n]]))
    assert joined.tolist() == [zlib.crc32(x + y) for x, y in zip(a[:n], b[:n], strict=True)]


def test_drawn_rows_come_back_whole(spark, odd):
    target = spark.createDataFrame([("der die und das",)], "text string")
    many = odd.unionByName(odd).unionByName(odd)
    out = resampling.resampled(many, target)
    assert out.columns == many.columns
    n = sum(len(words(r["text"])) >= 20 for r in many.select("text").collect())
    assert out.count() == 5 * n // 100 > 2


def test_empty_tables(spark, nothing):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resampling(nothing, empty).count() == 0
    assert resampling.resampled(nothing, empty).columns == nothing.columns
    one = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert found(resampling.resampling(one, empty)) == slow([(1, "a b c " * 10)], [])


def test_query_agrees_with_sql(spark, sf):
    assert assert_same(queries.QUERIES["op11_resampling"](spark, sf), connection(sf), queries.ORACLE_SQL["op11_resampling"]) > 0
