from __future__ import annotations

import random
import re
from itertools import combinations

import regex
from pyspark.sql import functions as F

from quillmark.llm import decontam
from quillmark.llm.common import row_keys

#: One letter of a script without spaces, or a run of other letters, digits and marks.
_OWN = r"[\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}\p{Hiragana}\p{Katakana}\p{Han}]"
TOKEN = regex.compile(rf"(?V1){_OWN}\p{{M}}*|[\p{{L}}\p{{N}}--{_OWN}](?:[\p{{L}}\p{{N}}\p{{M}}--{_OWN}])*")


def slow(docs: dict[int, str], items: dict[int, str]) -> set[tuple[int, int]]:
    """Pairs of which some aligned window agrees in 11 of 13 tokens, or in 4/5 of a shorter item."""
    out = set()
    toks = {i: TOKEN.findall(t.lower()) for i, t in docs.items()}
    for b, text in items.items():
        item = TOKEN.findall(text.lower())
        if len(item) < decontam.LEAST_TOKENS:
            continue
        w = min(13, len(item))
        known = set(item)
        for d, t in toks.items():
            near = {p - q for p, x in enumerate(t) if x in known for q, y in enumerate(item) if x == y}
            for diagonal in near:
                same = [0 <= q + diagonal < len(t) and t[q + diagonal] == x for q, x in enumerate(item)]
                if sum(same) * 5 >= 4 * w and any(sum(same[s : s + w]) * 5 >= 4 * w for s in range(len(item) - w + 1)):
                    out.add((d, b))
                    break
    return out


def test_masks_find_two_substitutions_in_a_window():
    for bad in combinations(range(13), 2):
        assert any(all(o + m not in bad for m in mask) for mask in decontam.MASKS for o in range(13 - decontam.SPAN + 1)), bad


def test_masks_of_short_items_avoid_all_admissible_substitutions():
    for n in range(1, decontam.WINDOW):
        for bad in combinations(range(n), n // 5):
            assert any(all(q + o not in bad and q + o < n for o in mask) for mask, q in decontam.short_masks(n)), (n, bad)


def test_query_agrees_with_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontam.op8_decontamination(spark, sf).collect() }
    assert got == slow(docs, items)
    assert got


def test_substitutions_short_items_and_odd_rows(spark, odd, nothing):
    rng = random.Random(9)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    changed = passage.copy()
    for i in (5, 11, 18, 24, 31, 37):
        changed[i] = "other"
    items = spark.createDataFrame([(1, " ".join(passage)), (2, "alpha beta gamma delta epsilon zeta"), (3, "too short"), (4, None), (5, ""), (6, " ".join(passage))], "item_id long, text string")
    rows = [(1, "before " + " ".join(changed) + " after"), (2, "x alpha, BETA gamma. delta epsilon zeta y"), (3, "too short"), (4, " ".join(passage[:12])), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 1)} == slow({r[0]: r[1] or "" for r in rows}, {r.item_id: r.text or "" for r in items.collect() if r.item_id != 6})
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, least_tokens=5).collect()} == {(1, 1), (2, 2), (4, 1)}
    assert [r.doc_id for r in decontam.decontaminated(docs, items).orderBy("doc_id").collect()] == [5, 6]
    out = decontam.decontaminated(odd, items)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert decontam.contaminated(nothing, items).count() == 0
    assert decontam.decontaminated(odd, items.limit(0)).count() == odd.count()


def test_short_items_with_all_admissible_substitutions(spark):
    items = {n: " ".join(f"i{n}t{k}" for k in range(n)) for n in range(1, 21)}
    docs = []
    for n, text in items.items():
        for lost in (0, n // 5, n // 5 + 1):
            every = list(combinations(range(n), lost))
            # All choices of places up to 13 tokens, every fortieth or so of longer items' many.
            for bad in every[:: 1 if n < 13 else len(every) // 60 + 1]:
                toks = ["x" if k in bad else w for k, w in enumerate(text.split())]
                docs += [" ".join(["before", *toks, "after"])] + [" ".join(toks).removeprefix("x ").removesuffix(" x")] * any(k in bad for k in (0, n - 1))
    docs = dict(enumerate(docs))
    rows = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(rows(docs).withColumnRenamed("id", "doc_id"), rows(items).withColumnRenamed("id", "item_id")).collect()}
    assert got == slow(docs, items)
    assert {b for _, b in got} == set(items)


def test_unspaced_scripts_marks_and_the_longest_of_equal_alignments(spark):
    items = {1: "東京は日本の首都です。人口は約千四百万人。", 2: "ภาษาไทยเขียนติดกันเสมอ", 3: "नमस्ते दुनिया कैसे हैं आप", 4: "lone", 5: "a a a a a b"}
    docs = {1: "前文 " + items[1] + " 後文", 2: "x" + items[2] + "y", 3: "कहा नमस्ते दुनिया कैसे हैं आप और", 4: "all lonely", 5: "a lone word", 6: "a a a a a a a a b a b", 7: "東京は日本の首都だ", 8: "e\u0301te\u0301 naïve"}
    rows = lambda d, k: spark.createDataFrame(list(d.items()), f"{k} long, text string")
    found = decontam.contaminated(rows(docs, "doc_id"), rows(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == slow(docs, items) == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 5)}
    assert [(r.n_matched, r.window_matched) for r in found if r.doc_id == 6] == [(6, 6)]
    toks = {r[0]: r[1] for r in rows(docs, "i").select("i", decontam.tokens("text")).collect()}
    assert all(toks[i] == TOKEN.findall(t.lower()) for i, t in docs.items())


def test_bits_of_all_seeds_are_set_and_few_others(spark):
    seeds = spark.range(3000).select(F.xxhash64("id").alias("seed"))
    bits, logs = decontam.bit_table(seeds, 3000)
    other = spark.range(3000, 23_000).select(F.xxhash64("id").alias("seed"))
    passed = lambda df: df.crossJoin(bits).where(decontam._maybe(F.col("seed"), F.col("_qm_bits"), logs)).count()
    assert passed(seeds) == 3000 and passed(other) < 20_000 / 10


def test_a_document_repeated_as_a_row_is_reported_and_dropped(spark):
    passage = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert [r.doc_id for r in decontam.decontaminated(docs, items).collect()] == [2]
    found = decontam.contaminated(docs, items).collect()
    assert {r.doc_id for r in found} == {1, None} and all(r.n_matched == r.item_tokens == 30 for r in found)


def test_items_of_every_length_stay_in_generated_code(spark, sf):
    """The probing stage is generated code that compiles, whatever the number of masks, and no row carries the bits."""
    seeds = spark.range(100).select(F.xxhash64("id").alias("seed"), F.xxhash64("id", "id").alias("begins"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *row_keys(), decontam._hashed("text").alias("_qm_h"))
    masks = list(dict.fromkeys([*decontam.MASKS, *(mask for n in range(1, decontam.WINDOW) for mask, _ in decontam.short_masks(n))]))
    before = spark.conf.get("spark.sql.codegen.fallback")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for some in (list(decontam.MASKS), masks):
            probes = decontam.probes(docs, seeds, 100, some)
            probes.collect()
            final = probes._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
            lines = [x for x in final.splitlines() if "Generate " in x]
            assert len(lines) == 3 and all("*(2)" in x for x in lines) and not any("_qm_bits" in x for x in lines)
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
