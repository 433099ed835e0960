"""Language identification of mixed-language text.

Words are runs of letters with their combining marks. A word's script narrows the languages to those that
were seen in that script; each of them scores the word by its character
trigrams. Viterbi over the words, with a penalty for every switch of language,
labels spans; a document's language is the one with most letters, of equal ones
the first by name.

A null text and one without letters are undetermined (und, score 0); long texts
are labelled whole; repeated rows get the same; an empty table gives an empty
one, and with nothing to learn from every text is undetermined. Rows without a
language are not learned from.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learned_from, small_batches, table, texts_of

BUCKETS = 1 << 15
#: Log score lost at each switch of language between two words.
SWITCH = 8.0
CACHE_WORDS = 150_000
#: Numbers of languages.
LABEL = np.int16
ALPHA = 0.3

#: First and last code point of ranges, and their script; letters elsewhere are "other".
SCRIPTS = (
    (0x41, 0x24F, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x530, 0x58F, "armenian"), (0x590, 0x5FF, "hebrew"),
    (0x600, 0x6FF, "arabic"), (0x700, 0x74F, "syriac"), (0x750, 0x77F, "arabic"), (0x780, 0x7BF, "thaana"), (0x8A0, 0x8FF, "arabic"),
    (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali"), (0xA00, 0xA7F, "gurmukhi"), (0xA80, 0xAFF, "gujarati"), (0xB00, 0xB7F, "oriya"),
    (0xB80, 0xBFF, "tamil"), (0xC00, 0xC7F, "telugu"), (0xC80, 0xCFF, "kannada"), (0xD00, 0xD7F, "malayalam"), (0xD80, 0xDFF, "sinhala"),
    (0xE00, 0xE7F, "thai"), (0xE80, 0xEFF, "lao"), (0xF00, 0xFFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1200, 0x139F, "ethiopic"), (0x13A0, 0x13FF, "cherokee"), (0x1780, 0x17FF, "khmer"), (0x1800, 0x18AF, "mongolian"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"), (0x31F0, 0x31FF, "kana"),
    (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"), (0xF900, 0xFAFF, "han"), (0x20000, 0x323AF, "han"),
)
SCRIPT_NAMES = (*sorted({s for _, _, s in SCRIPTS}), "other")
#: Counts leave a task after so many languages.
FLUSH_LANGS = 64
UNDETERMINED = "und"
_MARKS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
#: Marks begin at U+0300; the look ahead spares other characters the search among all marks.
_WORD = re.compile(rf"[^\W\d_]+(?:(?=[\u0300-\U0010ffff])[{_MARKS}]+[^\W\d_]*)*")
_ASCII_WORD = re.compile("[a-z]+")


def _lettered(word: str) -> bool:
    """Whether a letter is in what may be fractions or raised digits alone."""
    return word.isalpha() or any(map(str.isalpha, word))


def words_of(text: str) -> list[str]:
    text = text.lower()
    return _ASCII_WORD.findall(text) if text.isascii() else list(filter(_lettered, _WORD.findall(text)))


def script_of(word: str) -> str:
    c = ord(word[0])
    if c < 0x250:
        return "latin"
    return next((s for lo, hi, s in SCRIPTS if lo <= c <= hi), "other")


def trigram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, each between two marks, and where each word's begin."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 2)
    h = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    h = ((h ^ (h >> np.uint64(17))) % np.uint64(BUCKETS)).astype(np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return h[inside[:-2]], np.concatenate(([0], np.cumsum(sizes)[:-1]))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (BUCKETS, languages), float32
    scripts: dict[str, np.ndarray]  # script -> penalty of each language: 0 or far below

    def word_scores(self, words: list[str]) -> np.ndarray:
        slots, starts = trigram_slots(words)
        s = np.add.reduceat(self.logp[slots], starts, axis=0)
        for i, w in enumerate(words):
            if (p := self.scripts.get(script_of(w))) is not None:
                s[i] += p
        return s


def count_trigrams(batches):
    """(lang, cell, n) of (lang, text): numbers of hashed trigrams, then of words by script."""
    counts: dict[str, np.ndarray] = {}

    def out():
        for lang, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], names=["lang", "cell", "n"])
        counts.clear()

    for b in batches:
        words: dict[str, Counter] = {}
        for lang, x in zip(b.column(0).to_pylist(), texts_of(b, 1), strict=True):
            words.setdefault(lang, Counter()).update(words_of(x.decode("utf-8", "replace")))
        for lang, some in words.items():
            if not some:
                continue
            row = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
            distinct, n = list(some), np.fromiter(some.values(), np.int64, len(some))
            slots, _ = trigram_slots(distinct)
            np.add.at(row, slots, np.repeat(n, np.fromiter(map(len, distinct), np.int64, len(distinct))))
            np.add.at(row, [BUCKETS + SCRIPT_NAMES.index(script_of(w)) for w in distinct], n)
        if len(counts) > FLUSH_LANGS:
            yield from out()
    yield from out()


def train(langs: list[str], table: np.ndarray) -> Model:
    """From the numbers that ``count_trigrams`` gives: a column for each language."""
    counts, words = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * BUCKETS))
    # A language that has a script in less than a thousandth of its words is no candidate there, unless none has more.
    total = np.maximum(words.sum(axis=0), 1)
    scripts = {s: np.where(c >= np.minimum(total / 1000, c.max()), 0.0, -1e4) for s, c in zip(SCRIPT_NAMES, words, strict=True) if c.any()}
    return Model(langs, logp.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; ``scores`` holds the documents' words one after another, ``sizes`` (> 0) their numbers.

    All documents advance together, the longest first, so that a step is a few numpy calls.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    long = sizes[order]
    n, width = len(scores), scores.shape[1]
    came = np.empty((n, width), LABEL)
    own = np.arange(width, dtype=LABEL)
    active = np.searchsorted(-long, -np.arange(long[0]), side="left")
    at = starts.copy()
    delta = scores[at].astype(np.float64)
    came[at] = own
    labels = np.empty(n, LABEL)
    finals = np.empty(len(sizes), LABEL)
    for t in range(1, long[0]):
        k = active[t]
        if k < len(delta):
            finals[k : len(delta)] = delta[k:].argmax(axis=1)
            delta = delta[:k]
        at = starts[:k] + t
        best = delta.argmax(axis=1)
        jump = np.take_along_axis(delta, best[:, None], axis=1) - switch
        stay = delta >= jump
        came[at] = np.where(stay, own, best[:, None])
        delta = np.where(stay, delta, jump)
        delta += scores[at]
    finals[: len(delta)] = delta.argmax(axis=1)
    state = np.empty(0, LABEL)
    for t in range(long[0] - 1, -1, -1):
        k = active[t]
        if k > len(state):
            state = np.concatenate((state, finals[len(state) : k]))
        at = starts[:k] + t
        labels[at] = state
        state = came[at, state]
    return labels


def _predict(model: Model):
    def run(batches):
        cache: dict[str, int] = {}
        scores = np.empty((0, len(model.langs)), np.float32)
        for b in batches:
            docs = [words_of(x.decode("utf-8", "replace")) if x else [] for x in texts_of(b, 1)]
            if len(cache) > CACHE_WORDS:
                cache, scores = {}, scores[:0]
            fresh = list({w for d in docs for w in d}.difference(cache))
            if fresh and model.langs:
                cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh)), strict=True))
                scores = np.concatenate((scores, model.word_scores(fresh)))
            sizes = np.array([len(d) for d in docs], np.int64)
            some = np.nonzero(sizes)[0]
            langs, shares, spans = [UNDETERMINED] * len(docs), [0.0] * len(docs), [0] * len(docs)
            if len(some) and model.langs:
                ids = np.fromiter((cache[w] for d in docs for w in d), np.int64, int(sizes.sum()))
                letters = np.fromiter((len(w) for d in docs for w in d), np.int64, len(ids))
                labels = viterbi(scores[ids], sizes[some])
                ends = np.cumsum(sizes[some])
                for i, lo, hi in zip(some.tolist(), (ends - sizes[some]).tolist(), ends.tolist(), strict=True):
                    own = labels[lo:hi]
                    weight = np.bincount(own, letters[lo:hi], len(model.langs))
                    top = int(weight.argmax())
                    langs[i], shares[i] = model.langs[top], float(weight[top] / weight.sum())
                    spans[i] = 1 + int(np.count_nonzero(own[1:] != own[:-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, pa.int32())], names=["doc_id", "lang_pred", "score", "n_spans"])

    return run


def label_spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one text, in code points; gaps belong to the span before."""
    found = [m for m in _WORD.finditer(text.lower()) if _lettered(m[0])]
    if not found or not model.langs:
        return []
    labels = viterbi(model.word_scores([m[0] for m in found]), np.array([len(found)]))
    cuts = [0, *(np.nonzero(labels[1:] != labels[:-1])[0] + 1).tolist(), len(found)]
    return [(found[a].start(), found[b - 1].end(), model.langs[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def fit(docs: DataFrame, k: int = 4, r: int = 2) -> Model:
    """Learn from all rows with a language whose crc32(doc_id) mod k is not r; only sums by language and trigram are collected.

    With no row to learn from, every prediction is undetermined.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learned_from(k, r))
    small_batches(docs.sparkSession, 1024)
    part = known.select(F.col("lang").alias("_qm_lang"), F.col("text").cast("binary").alias("_qm_b")).mapInArrow(count_trigrams, "lang string, cell int, n long")
    rows = part.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    column = np.array([langs.index(x) for x in names.dictionary.to_pylist()], np.int64)
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    if rows.num_rows:
        table[rows["cell"].to_numpy(), column[names.indices.to_numpy()]] = rows["n"].to_numpy()
    return train(langs, table)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans) of every row; und and 0 where the text is null or has no letters."""
    small_batches(docs.sparkSession, 1024)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_qm_b")).mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, n_spans int")


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, fit(docs)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "n_spans")
