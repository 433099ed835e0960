from __future__ import annotations

import json
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from quillmark.llm import decontam, pii, quality
from quillmark.llm.common import materialize, table
from tests.llm.test_decontam import slow
from tests.llm.test_mixing import WORD, slow_targets
from tests.llm.test_pii import plain
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_stages_follow_each_other_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), f"test-{name}")
        kept[name] = docs
        if name != "mixing":
            assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    text_of = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    ids = {name: {r.doc_id for r in df.collect()} for name, df in kept.items()}

    net = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert ids["quality"] == {i for i, t in text_of.items() if quality.probability(net, t.encode()) >= quality.THRESHOLD}

    root = slow_components({i: slow_fingerprint(text_of[i]) for i in ids["quality"]})
    assert ids["near_dedup"] == set(root.values())

    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    short = {i: text_of[i] for i in ids["near_dedup"]}
    leaked = {d for d, _ in slow(short, items)}
    assert leaked and ids["decontamination"] & set(short) == set(short) - leaked
    assert decontam.contaminated(kept["decontamination"], table(spark, sf, "benchmark")).count() == 0

    assert ids["pii"] == ids["decontamination"]
    texts = {r.doc_id: r.text for r in kept["pii"].collect()}
    assert not any(spans for t in texts.values() for spans in plain(t).values()) and any("<EMAIL>" in t for t in texts.values())
    assert all(texts[i] == text_of[i] for i in texts if not pii.find_spans(text_of[i]))

    mixed = {r.doc_id: r for r in kept["mixing"].collect()}
    source = {r.doc_id: r.source for r in kept["pii"].collect()}
    sizes, taken, words_of = Counter(), Counter(), lambda pieces: [w for p in pieces for w in WORD.findall(p["text"])]
    for i, r in mixed.items():
        assert r.text == texts[i] and r.source == source[i]
        drawn = Counter(words_of(json.loads(r.pieces)))
        assert sum(drawn.values()) == r.taken and all(n <= 3 * Counter(WORD.findall(texts[i]))[w] for w, n in drawn.items())
        assert r["size"] == len(WORD.findall(texts[i])) and r.taken <= 3 * r["size"]
        sizes[source[i]] += r["size"]
        taken[source[i]] += r.taken
    targets = slow_targets(sizes)
    assert set(mixed) == ids["pii"] and all(abs(taken[s] - t) <= max(128, 0.01 * t) for s, t in targets.items())


def test_runs_agree(spark, sf):
    rows = [sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "size", "taken").collect())) for _ in range(2)]
    assert rows[0] == rows[1]


def test_odd_rows_clashing_columns_and_empty_tables(spark, odd, nothing, labels, tmp_path):
    extra = {c: F.lit("x") for c in ("seed", "word", "key", "_qm_k1", "score")}
    benchmark = spark.createDataFrame([(1, "the of and to in that was his with for as had on at by"), (None, None), (2, "")], "item_id long, text string")
    for name, docs, known, items in (("odd", odd, labels, benchmark), ("empty", nothing, labels, benchmark), ("bare", odd, labels.limit(0), benchmark.limit(0))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        known.withColumns(extra).write.parquet(f"{sf}/labels.parquet")
        items.withColumns(extra).write.parquet(f"{sf}/benchmark.parquet")
        held = {(r.doc_id, r.source) for r in docs.collect()}
        kept = table(spark, sf, "documents")
        for stage, f in corpus_pipeline.STAGES[1:]:
            kept = materialize(f(spark, kept, sf), f"odd-{stage}")
            assert stage == "mixing" or kept.columns == docs.columns
        rows = kept.collect()
        assert {(r.doc_id, r.source) for r in rows} <= held and (len(rows) > 30) == (name != "empty")
        assert all(r.taken == 0 and json.loads(r.pieces) == [] for r in rows if not WORD.findall(r.text or ""))
        assert name == "empty" or sum(not (r.text or "").strip() for r in rows) == 1
        assert {(r.doc_id, r.source) for r in corpus_pipeline.run(spark, sf).collect()} <= held

