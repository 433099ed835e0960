"""Operators that learn: held-out accuracy, what they may see, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import langid, lm, quality, toxicity

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def remainder(i: int, k: int) -> int:
    return zlib.crc32(str(i).encode()) % k


# ---- language ------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = langid.op3_langid(spark, SF01).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.98


def test_viterbi_agrees_with_trying_all_paths():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 1, 5, 2])
    scores = rng.normal(0, 6, (sizes.sum(), 3)).astype(np.float32)
    got = langid.viterbi(scores, sizes, switch=4.0)
    at = 0
    for n in sizes:
        own = scores[at : at + n].astype(float)
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        total = own[np.arange(n), paths].sum(axis=1) - 4.0 * (paths[:, 1:] != paths[:, :-1]).sum(axis=1)
        mine = own[np.arange(n), got[at : at + n]].sum() - 4.0 * (got[at + 1 : at + n] != got[at : at + n - 1]).sum()
        assert np.isclose(mine, total.max())
        at += n


def test_viterbi_tells_three_hundred_languages_apart():
    scores = np.full((600, 300), -9.0, np.float32)
    scores[np.arange(600), np.repeat(np.arange(300), 2)] = 0
    assert langid.viterbi(scores, np.full(300, 2)).tolist() == np.repeat(np.arange(300), 2).tolist()
    assert langid.viterbi(scores, np.array([600]), switch=1.0).tolist() == np.repeat(np.arange(300), 2).tolist()


def test_the_first_by_name_of_equal_languages_is_told(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(3)], "doc_id long, text string")
    model = langid.train(["a", "b"], np.ones((langid.BUCKETS + len(langid.SCRIPT_NAMES), 2)))
    assert {r.lang_pred for r in langid.predictions(docs, model).collect()} == {"a"}


def slow_lang(model: langid.Model, text: str) -> tuple[str, float]:
    """Word by word in plain loops."""
    import re

    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return "und", 0.0
    own = []
    for w in words:
        s, marked = np.zeros(len(model.langs), np.float64), f" {w} "
        for i in range(len(w)):
            a, b, c = (ord(x) for x in marked[i : i + 3])
            h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**64
            s += model.logp[(h ^ (h >> 17)) % langid.BUCKETS]
        own.append(s + model.scripts.get(langid.script_of(w), 0))
    best, came = own[0], []
    for s in own[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - langid.SWITCH
        came.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - langid.SWITCH) + s
    at = [int(best.argmax())]
    for c in reversed(came):
        at.append(int(c[at[-1]]))
    weight = np.bincount(at[::-1], [len(w) for w in words], len(model.langs))
    return model.langs[int(weight.argmax())], float(weight.max() / weight.sum())


def test_language_query_agrees_with_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model, texts = langid.fit(docs), {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op3_langid(spark, sf).collect()}
    want = {i: slow_lang(model, t) for i, t in texts.items()}
    assert sum(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-3 for i in texts) >= 0.99 * len(texts)


def test_mixed_text_gets_spans(odd):
    model = langid.fit(odd)
    from tests.llm.conftest import WORDS

    text = " ".join(WORDS["en"] * 2) + " " + " ".join(WORDS["de"] * 2)
    spans = langid.label_spans(model, text)
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - len(" ".join(WORDS["en"] * 2))) < 8


def test_language_of_odd_rows(odd, nothing):
    model = langid.fit(odd)
    got = langid.predictions(odd, model).collect()
    assert len(got) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (40, 41, 42, 45))
    assert langid.predictions(nothing, model).count() == 0
    none = langid.fit(nothing)
    assert {r.lang_pred for r in langid.predictions(odd, none).collect()} == {"und"}


def test_words_keep_their_marks_and_their_script(spark):
    hindi, telugu, khmer, lao = "हिन्दी में लिखा", "తెలుగు భాష", "ភាសា ខ្មែរ", "ພາສາ ລາວ"
    assert langid.words_of(hindi) == hindi.split() and langid.words_of(f"{telugu}; {khmer} 12 {lao}") == f"{telugu} {khmer} {lao}".split()
    assert langid.words_of("Cafe\u0301 naïve² ½ ²³ \u0301 _x_1y") == ["cafe\u0301", "naïve²", "x", "y"]
    assert [langid.script_of(w) for w in (hindi, telugu, khmer, lao, "abc", "ಕನ್ನಡ", "ગુજરાતી")] == ["devanagari", "telugu", "khmer", "lao", "latin", "kannada", "gujarati"]
    known = {"hi": hindi, "te": telugu, "km": khmer, "lo": lao, "mr": "मराठी मध्ये लिहिलेले"}
    ids = [i for i in range(100) if remainder(i, 4) != 2]
    rows = [(i, f"{known[x]} {known[x]}", x) for i, x in zip(ids, list(known) * 6, strict=False)]
    docs = spark.createDataFrame(rows + [(1000, "½ ²³", None), (1001, "\u0301", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predictions(docs, langid.fit(docs)).collect()}
    assert all(got[i] == x for i, _, x in rows) and got[1000] == got[1001] == "und"


def test_language_is_learned_from_the_right_rows(odd):
    lied = odd.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.fit(lied).langs


def test_language_learns_from_each_row_once_and_by_its_own_language(spark):
    """One doc_id stands on a third of all rows, under two languages and none."""
    rows = [(1, f"one two three {'x' * (i % 5 + 1)}", "en") for i in range(300)] + [(1, "eins zwei drei", "de")] * 40 + [(1, "qqq www", None)] * 50
    rows += [(i, "der die das", "de") for i in range(3, 700) if remainder(i, 4) != 2]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    alone = [(lang, text) for _, text, lang in rows if lang]
    assert model.langs == ["de", "en"]
    want = np.zeros((langid.BUCKETS, 2))
    for lang, text in alone:
        want[:, model.langs.index(lang)] += np.bincount(langid.trigram_slots(text.split())[0], minlength=langid.BUCKETS)
    assert np.allclose(model.logp, np.log((want + langid.ALPHA) / (want.sum(axis=0) + langid.ALPHA * langid.BUCKETS)), atol=1e-5)


# ---- quality -------------------------------------------------------------------


def _accuracy(spark, rows, column: str, sf: str = SF01) -> tuple[float, float]:
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    s, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    above = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
    return float(above.mean()), float(np.mean([h[1] == h[2] for h in held]))


def test_quality_held_out_accuracy(spark):
    got = quality.op6_quality(spark, SF01).collect()
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    auc, accuracy = _accuracy(spark, got, "quality")
    assert auc > 0.9 and accuracy > 0.88


def test_quality_gradient():
    net = quality._new(np.random.default_rng(1))
    net.out[:] = np.random.default_rng(2).normal(0, 0.3, net.out.shape)
    for p in ("embed", "left", "right", "bias", "out", "out_bias"):
        setattr(net, p, getattr(net, p).astype(np.float64))
    data, label = b"some text of a document, long enough for a chunk or two. " * 9, 1
    grads = [np.zeros_like(p) for p in net.parts()]
    quality._backward(net, data, label, grads)
    loss = lambda: -np.log(quality.probability(net, data))
    for p, g in zip(net.parts(), grads, strict=True):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:3]:
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert np.isclose((up - down) / 2e-5, slope[i], rtol=2e-2, atol=1e-5)


def test_quality_features_see_the_whole_text():
    net = quality._new(np.random.default_rng(1))
    for n in (0, 1, 63, 64, 255, 256, 257, 5000, 100_000):
        data = bytes(np.random.default_rng(n).integers(97, 123, n, dtype=np.uint8))
        blocks = quality.padded(data)
        whole = quality._chunk_max(quality._groups(net, blocks))
        assert len(whole) == quality.chunks_of(n)
        assert np.allclose(quality.features(net, data), np.concatenate((whole.mean(axis=0), whole.max(axis=0))), atol=1e-4)
    long = b"a" * 50_000
    assert not np.allclose(quality.features(net, long), quality.features(net, long[:-8] + b"\xf0\x9f\x98\x80#@!%"))


def test_quality_sample_is_bounded_whatever_the_lengths(spark):
    from quillmark.llm.common import sample_texts

    rows = [(i, "x" * (10 if i % 2 else 1000) + str(i)) for i in range(400)] + [(7, "again")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    picked = spark.createDataFrame([(i, i % 3 % 2) for i in range(400)], "doc_id long, _qm_y int")
    got = sample_texts(docs, picked, 10_000, 10**9)
    assert sorted((r[0], r[1].decode()) for r in got) == sorted(set(rows))
    some = sample_texts(docs, picked, 10_000, 50_000)
    assert 50_000 <= sum(len(t) for _, t, _ in some) < 51_100 and 0.3 < np.mean([len(t) > 500 for _, t, _ in some]) < 0.7
    assert len(sample_texts(docs, picked, 20, 10**9)) == 20 and sample_texts(docs.limit(0), picked, 9, 9) == []


def test_training_sample_is_not_crowded_out(spark):
    """Repeated labels, labels of absent documents and a doc_id on very many rows leave the same sample."""
    from quillmark.llm.common import labelled_rows, sample_texts

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9)) for i in range(83)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(83)], "doc_id long, _qm_y int")
    plain = sample_texts(docs, known, 60, 10**9)
    assert len(plain) == 60
    crowded = known.unionByName(spark.createDataFrame([(5, 1)] * 1300 + [(10_000 + i, 1) for i in range(19_000)] + [(200, 1)], known.schema))
    hot = docs.unionByName(spark.range(300).selectExpr("5L as doc_id", "case when id % 2 = 0 then 'again' else concat('other ', id) end as text"))
    hot = hot.unionByName(spark.createDataFrame([(200, None)], docs.schema))
    got = sample_texts(hot, crowded, 60, 10**9)
    assert [r[0] for r in got] == [r[0] for r in plain] and [r for r in got if r[0] != 5] == [r for r in plain if r[0] != 5]
    rows = labelled_rows(hot, crowded, 1000)
    assert rows.where("_qm_more = 0").count() == 83 and rows.where("doc_id = 5").count() == 152
    assert labelled_rows(docs, known.limit(0), 10).count() == 0


def test_quality_query_agrees_with_plain_scores(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    net = quality.fit(docs, labels)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    weights = np.stack((net.left.T.reshape(quality.FILTERS, quality.STEP, quality.EMBED), net.right.T.reshape(quality.FILTERS, quality.STEP, quality.EMBED)), 1).reshape(quality.FILTERS, -1, quality.EMBED)

    def slow(data: bytes) -> float:
        width, chunk, step = 2 * quality.STEP, quality.GROUP * quality.CHUNK_GROUPS, quality.GROUP * quality.CHUNK_STEP
        n = quality.chunks_of(len(data))
        raw = np.zeros((step * (n - 1) + chunk + 1) * quality.STEP, int)
        raw[: len(data)] = list(data)
        y = np.array([np.maximum(0, np.tensordot(weights, net.embed[raw[p * quality.STEP : p * quality.STEP + width]], ([1, 2], [0, 1])) + net.bias) for p in range(step * (n - 1) + chunk)])
        most = np.array([y[i * step : i * step + chunk].max(axis=0) for i in range(n)])
        return 1 / (1 + np.exp(-(np.concatenate((most.mean(axis=0), most.max(axis=0))) @ net.out + net.out_bias[0])))

    got = {r.doc_id: r.score for r in quality.op6_quality(spark, sf).collect()}
    assert sorted(got) == sorted(texts)
    some = [i for i, t in texts.items() if len(t) < 5000][:60]
    assert np.allclose([got[i] for i in some], [slow(texts[i]) for i in some], atol=1e-4)


def test_quality_of_odd_rows(odd, nothing, labels):
    net = quality.fit(odd, labels)
    got = quality.scores(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[40] == by[41]
    kept = quality.accepted(odd, net, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.accepted(odd, net, 1.1).count() == 0 and quality.scores(nothing, net).count() == 0
    constant = quality.fit(nothing, labels)
    assert len({r.score for r in quality.scores(odd, constant).collect()}) == 1


# ---- toxicity ------------------------------------------------------------------


def test_toxicity_held_out_accuracy(spark):
    got = toxicity.op7_toxicity(spark, SF1).collect()
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    auc, accuracy = _accuracy(spark, got, "toxic", SF1)
    assert auc > 0.95 and accuracy > 0.98


@pytest.mark.parametrize(
    ("text", "weight", "n"),
    [("You idiot", 2.0, 1), ("you 1d10t!", 2.0, 1), ("іdіоt", 2.0, 1), ("IDIOT idiot", 4.0, 2), ("idiotic", 0.0, 0), ("a clown fish", 0.0, 0), ("clown, fish", 3.0, 1), ("two clown fish, one clown", 3.0, 1), ("10 1 5", 0.0, 0), ("", 0.0, 0), ("a c1own", 3.0, 1), ("c|own CLOWN", 6.0, 2)],
)
def test_matching(text, weight, n):
    a = toxicity.Model({"idiot": 2.0, "clown": 3.0}).automaton()
    assert toxicity.matches(a, toxicity.fold(text)) == (weight, n)


def test_toxicity_query_agrees_with_plain_matching(spark, sf):
    import math

    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    lexicon = {toxicity.fold(w): x for w, x in model.weights.items()}
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, sf).collect()}
    for r in docs.collect():
        text = toxicity.fold(r.text or "")
        found = []
        for w, x in lexicon.items():
            at = text.find(w)
            while at >= 0:
                end = at + len(w)
                if not (at and text[at - 1].isalnum()) and not text[end : end + 1].isalnum():
                    found.append((at, end, x))
                at = text.find(w, at + 1)
        free = [(i, i + len(e)) for e in map(toxicity.fold, model.exceptions) for i in range(len(text)) if text.startswith(e, i) and not text[i + len(e) : i + len(e) + 1].isalnum()]
        found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b in free)]
        want = toxicity.text_score(model, math.fsum(f[2] for f in found), len((r.text or "").split()))
        assert got[r.doc_id].n_matches == len(found) and math.isclose(got[r.doc_id].score, want, rel_tol=1e-6)


def test_a_group_of_copies_does_not_fill_the_lexicon(spark):
    rows = [(1, "zork flim grabble plonk quux wibble wobble sneeze " * 3 + str(i)) for i in range(200)]
    rows += [(1, f"{a} you nasty {b} thing {c} here") for a, b, c in zip("abcdefgh", "ijklmnop", "qrstuvwx", strict=True)]
    rows += [(0, f"{a} you kind {b} thing {c} here now {i}") for i, (a, b, c) in enumerate(zip("abcdefgh" * 9, "ijklmnop" * 9, "qrstuvwx" * 9, strict=True))]
    learned = toxicity.lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert "nasty" in learned and not {"zork", "wibble", "sneeze", "you", "here"} & set(learned)


def test_phrases_that_are_mostly_harmless_become_exceptions(spark):
    said = lambda i, words: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in ("one", "two", "six", "ten")) + f" {words} " + " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in ("red", "tan"))
    toxic = [(i, said(i, "nasty fool"), 1) for i in range(20)]
    mild = [(i, said(i, "nasty weather" if i < 26 else "fine weather"), 0) for i in range(20, 120)]
    docs, labels = spark.createDataFrame([r[:2] for r in toxic + mild], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in toxic + mild], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, 1, 1)
    assert "nasty" in model.weights and toxicity.fold("nasty weather") in model.exceptions and toxicity.fold("nasty fool") not in model.exceptions
    seen = {r.doc_id: r.n_matches for r in toxicity.matched(docs, model).collect()}
    assert seen[21] == 0 and seen[3] == 2
    assert toxicity.learned_exceptions(toxicity.clustered(labels.join(docs, "doc_id").select("toxic", "text")), {}) == ()


def test_toxicity_of_odd_rows(odd, nothing, labels):
    model = toxicity.fit(odd, labels)
    got = toxicity.matched(odd, model).collect()
    assert len(got) == odd.count() and all(r.weight >= 0 and r.n_words >= 0 for r in got)
    assert toxicity.matched(nothing, model).count() == 0
    assert toxicity.fit(nothing, labels).weights == {} == toxicity.fit(odd, labels.limit(0)).weights


# ---- language model --------------------------------------------------------------


def test_lm_base_score_agrees_with_brute_force(spark, sf):
    import math
    from collections import Counter

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    split = {i: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split(), b"\n"] for i, t in docs.items()}
    counts = Counter(w for i, ws in split.items() if remainder(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = lm.op4_lm(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ws = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), n, remainder(r.doc_id, 7) == 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_windows_score_each_id_once_and_never_look_ahead():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 15, 16, 17, 40, 3, 100])
    classes = rng.integers(3, lm.CLASSES, sizes.sum())
    net = lm.train_network(classes, sizes, epochs=1)
    scorer = lm.Scorer(net)
    _, _, spot = lm.windows(classes, sizes)
    assert sorted(spot[spot >= 0].tolist()) == list(range(len(classes)))
    before = scorer(classes, sizes)
    starts = np.cumsum(sizes) - sizes
    for at in (starts[4] + 20, starts[6] + 50):
        changed = classes.copy()
        changed[at] = 3 + (changed[at] - 2) % (lm.CLASSES - 3)
        after = scorer(changed, sizes)
        assert np.allclose(after[:at], before[:at], atol=1e-5)
        end = starts[np.searchsorted(starts, at, side="right") - 1] + sizes[np.searchsorted(starts, at, side="right") - 1]
        assert np.allclose(after[end:], before[end:], atol=1e-5)
    assert np.isfinite(before).all() and (before <= 1e-5).all()


def test_lm_gradient():
    rng = np.random.default_rng(8)
    sizes = np.array([20, 33])
    classes = rng.integers(3, lm.CLASSES, sizes.sum())
    net = lm.train_network(classes, sizes, epochs=1)
    ctx, tgt, at = lm.windows(classes, sizes)
    _, grads = lm._gradients(net, ctx, tgt, at)
    for p, g in zip(net.parts(), grads, strict=True):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:2]:
            was = flat[i]
            flat[i] = was + 1e-5
            up = lm._gradients(net, ctx, tgt, at)[0]
            flat[i] = was - 1e-5
            down = lm._gradients(net, ctx, tgt, at)[0]
            flat[i] = was
            assert np.isclose((up - down) / 2e-5, slope[i], rtol=1e-3, atol=1e-7)


def test_lm_words_outside_the_head_count_all_the_same(odd):
    rows = lambda head: sorted(((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.scored(odd, head_words=head).collect()))
    assert rows(200_000) == rows(20)


def test_lm_words_outside_the_head_score_all_the_same(odd):
    by = lambda head: sorted((r.n_tokens, r.score) for r in lm.scored(odd, head_words=head).collect())
    assert np.allclose(by(200_000), by(20), rtol=1e-6)


def test_lm_learns_from_all_training_texts(spark):
    """1,500 texts, of which each 10 hold a word of their own: more than any fixed sample would see."""
    texts = [f"the house of w{i // 10} is a w{i // 10} house" for i in range(1500)]
    training = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = lm.word_counts(training)
    coder = lm.Coder(lm.TOKENIZER)
    ids, sizes = coder([t.encode() for t in texts])
    want = np.bincount(ids, minlength=coder.enc.n_vocab + 1)[:-1] + 1
    n, types = sum(len(t.split()) + 1 for t in texts), len({w for t in texts for w in t.split()}) + 1
    model = lm.fit(training, counts, n, types, len(texts))
    size = np.bincount(model.class_of, want, lm.CLASSES)
    assert np.allclose(model.emit, np.log(want / size[model.class_of]))
    classes = np.append(model.class_of, lm.STOP)[ids]
    assert (lm.class_pairs(training, model.class_of) == lm.pair_counts(classes, sizes)).all()
    own, width = lm.own_classes(want), lm.OWN_CLASSES + 1
    column = np.full(coder.enc.n_vocab + 1, lm.OWN_CLASSES)
    column[own] = np.arange(len(own))
    near = np.zeros((coder.enc.n_vocab, 2 * width))
    for a, b in zip(ids, ids[1:], strict=False):
        if max(a, b) < coder.enc.n_vocab:
            near[b, column[a]] += column[b] == lm.OWN_CLASSES
            near[a, width + column[b]] += column[a] == lm.OWN_CLASSES
    assert near.any() and (lm.neighbours(training, own) == near).all()
    assert [x.count() for x in lm.shares(training, 1500 * 1000)][0] < 20
    assert 300 < lm.shares(training, 1500)[0].count() < 700


def test_lm_mixture_and_attention_see_every_text(spark):
    """The mixture is that of all texts, each scored by the counts of the others, and a start on no text still learns from all."""
    texts = [f"the house of w{i // 7} is a w{i // 7} house" if i % 3 else "rain " * (i % 5 + 1) + f"w{i}" for i in range(900)]
    training = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    counts = lm.word_counts(training)
    held = {bytes(r.word): r.c for r in counts.collect()}
    n, types = sum(held.values()), len(held)
    model = lm.fit(training, counts, n, types, len(texts), head={w: c for w, c in held.items() if c > 100})
    gaps = []
    for t in texts:
        s = lm.Words(model, {}, n, types).score([t.encode()])
        words = [s["distinct"][i] for i in s["ids"]]
        gaps += [net * np.log(10) - np.log((held[w] - words.count(w) + 1) / (n + types + 1)) for w, net in zip(words, s["network"], strict=True)]
    share = 0.5
    for _ in range(30):
        share = np.mean(share / (share + (1 - share) * np.exp(np.array(gaps))))
    assert abs(model.share - share) < 2e-3
    ids = lm.coded(training)
    pairs = lm.class_pairs(ids, model.class_of)
    start = training.limit(0).selectExpr("cast(text as binary) as _qm_b")
    net = lm.train_attention(start, ids, model.class_of, pairs)
    assert np.abs(net.out - lm.new_training(pairs).net.out).max() > 1e-3


def test_lm_network_passes_once_over_each_text(spark, monkeypatch):
    """What sets the mixture also makes the scores: the network sees no text twice."""
    texts = ["the house of the cat is a house", "a dog", "zebra crossing " * 30, ""] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    passes, networked = [], lm.networked
    monkeypatch.setattr(lm, "networked", lambda *args: passes.append(networked(*args)) or passes[-1])
    got = lm.scored(docs)
    assert got.count() == len(texts) == sum(x.count() for x in passes)
    held = got.join(passes[0].select("doc_id", "gaps", "tail"), "doc_id").selectExpr("bool_and(size(gaps) + size(tail) = n_tokens)").first()
    assert held[0]


def test_lm_slopes_in_single_precision_are_those_in_double():
    """A step in the arrays of the step before, of more windows, gives what it gives alone."""
    rng = np.random.default_rng(4)
    sizes = np.array([7, 300, 1, 64])
    classes = rng.integers(3, lm.CLASSES, sizes.sum())
    net, room = lm.train_network(classes, sizes, epochs=1), lm.Room()
    some = lm.Network(*(x.astype(np.float32) for x in net.parts()))
    ctx, tgt, at = lm.windows(classes, sizes)
    for n in (len(ctx), 3):
        loss, want = lm._gradients(net, ctx[:n], tgt[:n], at[:n])
        near, got = lm._gradients(some, ctx[:n], tgt[:n], at[:n], room)
        assert np.isclose(loss, near, rtol=1e-5)
        assert all(g.dtype == np.float32 and np.allclose(w, g, atol=1e-5) for w, g in zip(want, got, strict=True))


def test_lm_words_of_the_head_are_not_encoded_anew(monkeypatch):
    """Tasks get the subwords of the head's words, and encode only others; ids are those without a head."""
    texts = [b"the house of the zebra", b"", b"a house x\xc3\xa9\xe2\x80\x93y the", b"the of the"]
    ids, sizes = lm.Coder(lm.TOKENIZER)(texts)
    head = lm.Head.of({b"the": 7, lm.END: 4, b"of": 3, b"house": 2})
    encoded, subwords = [], lm.subwords
    monkeypatch.setattr(lm, "subwords", lambda words, path: encoded.extend(words) or subwords(words, path))
    coder = lm.Coder(lm.TOKENIZER, head)
    for _ in range(2):
        got, per = coder(texts)
        assert got.tolist() == ids.tolist() and per.tolist() == sizes.tolist()
    assert sorted(encoded) == sorted(2 * [b"zebra", b"a", "x\u00e9\u2013y".encode()])


def test_lm_scorer_gives_what_its_windows_give():
    """The scorer's windows are views of all halves; those that reach into the next sequence are not used."""
    rng = np.random.default_rng(6)
    sizes = np.array([1, 16, 17, 2500, 31, 32, 33, 1])
    classes = rng.integers(3, lm.CLASSES, sizes.sum())
    net = lm.train_network(classes, sizes, epochs=1)
    ctx, tgt, spot = lm.windows(classes, sizes)
    pair, mask = lm._tables(net, np.float64)
    last = ctx[:, lm.HALF :]
    weight = pair[last[:, :, None], ctx[:, None, :]] * mask
    logits = (weight @ net.value[ctx]) / weight.sum(axis=2, keepdims=True) @ net.out + net.own[last]
    law = np.exp(logits) / np.exp(logits).sum(axis=2, keepdims=True)
    begin, want, starts = rng.random(lm.CLASSES) < 0.3, np.empty(len(classes)), np.empty(len(classes))
    real = spot >= 0
    want[spot[real]] = np.log(np.take_along_axis(law, tgt[:, :, None], axis=2)[:, :, 0][real])
    starts[spot[real]] = np.log(law[:, :, begin].sum(axis=2)[real])
    got = lm.Scorer(net, begin).both(classes, sizes)
    assert np.allclose(got[0], want, atol=1e-4) and np.allclose(got[1], starts, atol=1e-4)


def test_lm_sums_of_runs_and_large_logits():
    rng = np.random.default_rng(7)
    for kind in (np.float32, np.float64):
        rows, starts = rng.normal(size=(50, 6)).astype(kind), np.array([0, 1, 20, 49])
        assert np.allclose(lm._run_sums(rows, starts), np.add.reduceat(rows, starts, axis=0), atol=1e-5)
    classes, sizes = rng.integers(3, lm.CLASSES, 40), np.array([40])
    net = lm.train_network(classes, sizes, epochs=1)
    net.own[:] = 500
    assert np.isfinite(lm._gradients(net, *lm.windows(classes, sizes))[0])


def slow_log10(model: lm.Model, words: list[bytes]) -> list[float]:
    """The network's log10 probability of each word, and of the end, one id after another in plain loops."""
    import math

    net, begin, enc = model.network, lm.begin_classes(model.class_of, lm.begins()), lm.tokenizer()
    ids = [enc.encode_ordinary(" " + w.decode()) for w in words]
    seq = [int(model.class_of[i]) for x in ids for i in x] + [lm.STOP]

    def law(t: int) -> np.ndarray:
        first = t // lm.HALF * lm.HALF - lm.HALF - 1
        seen = [(t - 1 - j, lm.START if j < 0 else seq[j]) for j in range(max(first, -1), t)]
        last = seen[-1][1]
        w = [math.exp(np.clip(net.query[last] @ net.key[c], -20, 20)) * math.exp(np.clip(net.place[d], -20, 20)) for d, c in seen]
        mean = sum(x * net.value[c] for x, (_, c) in zip(w, seen, strict=True)) / sum(w)
        z = net.own[last] + mean @ net.out
        return np.exp(z) / np.exp(z).sum()

    out, t = [], 0
    for x in ids:
        p = 1 / law(t)[begin].sum()
        for i in x:
            p *= law(t)[model.class_of[i]] * math.exp(model.emit[i])
            t += 1
        out.append(math.log10(p * law(t)[begin].sum()))
    return [*out, math.log10(law(t)[lm.STOP] / law(t)[begin].sum())]


def small_model(spark):
    texts = ["the house of the cat is a house", "a cat and a dog of the house, naïve and e.g. odd-looking", "the dog is the dog", "that was his dog, and the cat was hers"] * 9 + ["", "zebra 12 crossing", "the the the " * 40 + "xyzzy"]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").where(lm.learned_from(7, 2))
    counts = {r[0]: r[1] for r in lm.word_counts(training).collect()}
    n, v = sum(counts.values()), len(counts)
    return texts, counts, n, v, lm.fit(training, lm.word_counts(training), n, v, training.count())


def test_lm_probabilities_sum_to_one_at_most(spark):
    _, counts, n, v, model = small_model(spark)
    words = lm.Words(model, counts, n, v)
    some = [w for w in counts if w != lm.END] + [b"neverseen"]
    for prefix in ([], [b"the"], [b"a", b"dog", b"neverseen"], [b"the", b"house"] * 30):
        texts = [b" ".join([*prefix, w]) for w in some] + [b" ".join(prefix)]
        s = words.score(texts)
        every = [s["distinct"][i] for i in s["ids"]]
        unigram = np.log10([counts.get(w, 0) + 1 for w in every]) - np.log10(n + v + 1)
        chance = 10 ** lm.mixture(model.share, s["network"], unigram)
        at = [*(s["starts"][:-1] + len(prefix)), s["starts"][-1] + len(prefix)]
        assert [every[i] for i in at] == [*some, lm.END]
        assert 0.3 < chance[at].sum() <= 1 + 1e-6 and (10 ** s["network"][at]).sum() <= 1 + 1e-6


def test_lm_score_agrees_with_brute_force(spark):
    import math

    texts, counts, n, v, model = small_model(spark)
    got = {r.doc_id: r.score for r in lm.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), head_words=5).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, x in list(enumerate(texts))[-8:]:
        words = x.lower().encode().split()
        chances = zip([*words, lm.END], slow_log10(model, words), strict=True)
        want = sum(math.log10(model.share * (counts.get(w, 0) + 1) / (n + v + 1) + (1 - model.share) * 10**p) for w, p in chances)
        assert math.isclose(got[i], want, rel_tol=1e-4)


def test_lm_tokens_are_the_words_and_the_ends():
    texts = [b" a  B\x0bc\x0cd\x1ce\xc2\x85 \xc2\xa0f ", b"", b"\xff\xfe bad", b" \n ", "É É x".encode(), b"x"]
    t = lm.Tokens.of(texts)
    want = [w for x in texts for w in (*x.lower().split(), lm.END)]
    assert [t.distinct[i] for i in t.ids] == want and t.sizes.tolist() == [len(x.split()) + 1 for x in texts]
    assert lm.Tokens.of([]).sizes.tolist() == []


def test_lm_subwords_of_many_words_are_those_of_each():
    words = "plain naïve 12,5 e.g. \u00a0 a\u00a0b x\u2003 東京 'tis it's <|endoftext|> \x1c \x85 --".encode().split() + [b"\xff\xfebad"]
    for some in (words, words[:-1], words[:1], []):
        ids, sizes = lm.subwords(some)
        want = [lm._alone(lm.TOKENIZER, w) for w in some]
        assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
        assert all(lm.begins()[x[0]] and not lm.begins()[x[1:]].any() for x in want)


def test_lm_of_odd_rows(odd, nothing):
    got = lm.scored(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (40, 41, 42))
    assert lm.scored(nothing).count() == 0
    untrained = lm.scored(odd.where("doc_id is null")).collect()
    assert len(untrained) == 1 and untrained[0].train_tokens == 0 and untrained[0].n_known == 0
