from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import xxhash

from quillmark.llm import simhash
from quillmark.llm.components import components


def slow_fingerprint(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    k = min(4, len(words))
    votes = [0] * 64
    n = len(words) - k + 1
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def slow_components(prints: dict[int, int]) -> dict[int, int]:
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


def test_fingerprint_agrees_with_brute_force():
    rng = random.Random(1)
    for text in ["", "one", "A b\tC", "Ä ö" * 9, *(" ".join(rng.choices("Ab cd éf gh ij".split(), k=k)) for k in (3, 4, 5, 40, 999))]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_query_agrees_with_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: slow_fingerprint(t or "") for i, t in docs.items()}
    expected = slow_components(prints)
    got = simhash.op10_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", expected[i]) for i, p in prints.items()}
    assert len(got) == len(docs)


def test_links_find_every_close_pair_for_any_number_of_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = {x: x for x in base}
    for x in base:
        for d in (1, 2, 3, 4, 5):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            prints[y] = y
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    expected = slow_components(prints)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for blocks, chunk in ((6, 256), (8, 256), (6, 4)):
        monkeypatch.setattr(simhash, "block_count", lambda n, b=blocks: b)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        edges = simhash.links(df, len(prints)).collect()
        parent = {x: x for x in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in edges:
            a, b = r.u % (1 << 64), r.v % (1 << 64)
            assert (a ^ b).bit_count() <= 4
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        groups = {}
        for x in prints:
            groups.setdefault(root(x), set()).add(x)
        slow = {}
        for x in prints:
            slow.setdefault(expected[x], set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_block_masks_cover_any_four_bits():
    rng = np.random.default_rng(2)
    for b in (6, 7, 9):
        masks = simhash.block_masks(b)
        for _ in range(300):
            flips = sum(1 << int(x) for x in rng.choice(64, 4, replace=False))
            assert any(not flips & m for m in masks)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, x) for x in range(8, 40)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (200, 201), (201, 200), (200, 201)], "u long, v long")
    got = {(r.u, r.v) for r in components(edges).collect()}
    assert got == {(i, 100) for i in range(101, 161)} | {(x, 7) for x in range(8, 40)} | {(201, 200)}
    assert components(edges.limit(0)).count() == 0


def test_odd_rows(odd, nothing):
    got = simhash.classes(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[40].fp == by[41].fp == by[42].fp == 0
    assert {by[40].component_id, by[41].component_id, by[42].component_id} == {40}
    assert by[43].component_id == by[5].component_id == 5
    assert simhash.classes(nothing).count() == 0


def test_near_dedup_keeps_one_of_each_group(odd, nothing):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(3) == 1 and 43 not in ids and 41 not in ids and 42 not in ids and 40 in ids and None in ids
    assert simhash.near_dedup(nothing).count() == 0


def test_ids_of_any_type_and_hot_or_no_hot_classes(spark, monkeypatch):
    from quillmark.llm import simhash

    texts = ["one two three four five six seven"] * 5 + ["other words stand here and there today", None]
    docs = spark.createDataFrame([(f"id-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    want = {("id-0", "id-0"), *((f"id-{i}", "id-0") for i in range(5)), ("id-5", "id-5"), ("id-6", "id-6")}
    assert {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()} == want
    for hot in (0, 2, 1 << 40):  # none, the one of 5 in 7 rows, all
        monkeypatch.setattr(simhash, "HOT", hot)
        assert {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()} == want
        assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == ["id-0", "id-5", "id-6"]
