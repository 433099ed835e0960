from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    rest = float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_query_meets_its_targets(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = mixing.op1_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    targets = slow_targets(sizes)
    taken = Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and r.source_size == sizes[s]
        assert math.isclose(r.target, targets[s], rel_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(128, 0.01 * t)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.op1_mixing(spark, sf).collect()}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 3}, {"a": 1, "b": 1, "c": 10_000}, {"a": 7}, {"a": 0, "b": 5}])
def test_targets_agree_with_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = slow_targets(sizes)
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_hypergeometric_law(spark):
    big, good, draws = 60, 25, 20
    u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    got = Counter(int(r[0]) for r in u.select(F.expr(mixing.hypergeometric(f"{big}D", f"{good}D", f"{draws}D", "u"))).collect())
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(big - good, draws - k) / math.comb(big, draws)
        assert abs(got[k] / 4000 - p) < 0.002


def test_tree_splits_every_quota_exactly(spark):
    quotas = [0, 1, 977, 50_000, 3]
    root = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    for shards in (1, 2, 7, 16, 600):
        leaves = mixing.split_tree(root, shards).collect()
        assert sorted(r.shard for r in leaves) == list(range(shards))
        assert [sum(r.quotas[i] for r in leaves) for i in range(len(quotas))] == quotas
        sums = [sum(r.quotas) for r in leaves]
        assert max(sums) - min(sums) <= 1 and all(q >= 0 for r in leaves for q in r.quotas)


def test_shards_hold_disjoint_draws_of_whole_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixture(docs, shard_words=20_000).collect()
    spans = defaultdict(list)
    for r in rows:
        assert r.n_words > 0
        spans[r.doc_id, r.repeat].append((r.first_word, r.first_word + r.n_words))
    for s in spans.values():
        s.sort()
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))
    assert len({r.shard for r in rows}) > 3
    by = Counter()
    for r in rows:
        by[r.shard] += r.n_words
    assert max(by.values()) - min(by.values()) < 0.15 * max(by.values())


def test_places_are_a_shuffle_of_each_shard_and_runs_tile_the_draws(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixture(docs, shard_words=5_000).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append((r.place, r.doc_id))
    assert len(by) > 10
    for some in by.values():
        assert sorted(p for p, _ in some) == list(range(1, len(some) + 1))
    first = [d for _, d in sorted(by[0])]
    assert first != sorted(first) and len(set(first[: len(first) // 2])) > 5
    size, quota = Counter(), Counter()
    for r in rows:
        size[r.source] += r.n_words
        quota[r.source, r.repeat] += 1
    again = {(r.doc_id, r.taken, r.places_hash) for r in mixing.taken(docs, 5_000).collect()}
    assert again == {(r.doc_id, r.taken, r.places_hash) for r in mixing.taken(docs.repartition(7), 5_000).collect()}
    assert sum(t for _, t, _ in again) == sum(size.values())


def test_the_written_corpus_holds_the_words_taken(spark, odd, tmp_path):
    import json

    mix = mixing.mixed(odd, shard_words=4_000)
    rows = mix.collect()
    assert len(rows) == odd.count()
    for r in rows:
        pieces = json.loads(r.pieces)
        assert sum(len(WORD.findall(p["text"])) for p in pieces) == r.taken
        assert all(p["text"] in " ".join(WORD.findall(r.text or "")) for p in pieces)
    path = f"file://{tmp_path}/mix"
    mixing.corpus(mix, path)
    written = spark.read.parquet(path).collect()
    key = lambda x: (x[0], x[1])
    assert sorted(((w.shard, w.place, w.text) for w in written), key=key) == sorted(((p["shard"], p["place"], p["text"]) for r in rows for p in json.loads(r.pieces)), key=key)


def test_odd_rows(odd, nothing):
    got = mixing.taken(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken == 0 and r.size == 0 for r in got if r.doc_id in (40, 41, 42))
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.taken(nothing).count() == 0 and mixing.mixture(nothing).count() == 0
    blank = odd.where("doc_id between 40 and 42")
    assert {(r.target, r.taken) for r in mixing.taken(blank).collect()} == {(0.0, 0)}
