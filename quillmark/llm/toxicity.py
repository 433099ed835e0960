"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps homoglyphs and digit substitutions to plain letters. Matches must
stand as whole words and outside exception phrases; their weights are
normalised by the length of the text.

A null text counts as empty, whose score is that of no match; long texts are
matched whole; repeated rows score alike; an empty table gives an empty one, and
with nothing to learn from the lexicon is empty. Null labels are not learned
from.

The lexicon is learned from labelled texts, a bounded number of them; it holds
every word with the support and the weight asked for, and the exceptions every
such phrase, so both are bounded by that sample alone. A word's support is
counted in clusters of near copies (two of four min-hashes agree), so the words of a large
group of copies don't enter by its size. Exception phrases are some fixed ones
and those learned: two words, one of them of the lexicon, that stand side by
side in clusters of texts nearly none of which is toxic.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import combinations, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_rows, learned_from, materialize, small_batches, table, texts_of, whole_texts

THRESHOLD = 0.7
#: Bound of the labelled rows that the model is fitted on: those of the least hashes of doc_id.
TRAIN_ROWS = 12_000
#: A word of the lexicon stands in so many clusters of toxic texts at least.
SUPPORT, SUPPORT_SHARE = 3, 0.003
#: Log odds of a word in toxic over other texts.
LEAST_WEIGHT = 2.5
#: A learned exception stands in clusters of which at most this share is toxic, smoothed by half a cluster.
EXCEPTION_SHARE = 0.1
#: Words in a shingle of the clusters.
SHINGLE = 5

#: Look-alike letters and digits, and what they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "м": "m", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}
#: Full-width forms and zero-width marks follow a rule.
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFEE0 + i: chr(i).lower() for i in range(0x21, 0x7F)} | dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))

#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clown car", "circus clown", "pond scum", "sore loser board game")

_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[^\s]+")


def fold(text: str) -> str:
    """Lower case with look-alikes replaced; l is written i, since one sign stands for either.

    A digit or sign is replaced only inside a chunk that also has letters, so
    numbers and rows of signs stay as they are; signs at a chunk's ends go.
    """
    text = text.lower()
    if text.isascii() and not _ODD.search(text):
        return text.replace("l", "i")
    return _RUN.sub(lambda m: _fold_chunk(m[0]), text).replace("l", "i")


_ODD = re.compile(r"[0134578@$!|]")
_ENDS = re.compile(r"^[^\w@$]+|[^\w]+$")


def _fold_chunk(chunk: str) -> str:
    core = _ENDS.sub("", chunk)
    if not core or not any(c.isalpha() for c in core):
        return chunk
    return core.translate(_FOLD)


@dataclass
class Model:
    weights: dict[str, float]
    bias: float = -6.0
    slope: np.ndarray = field(default_factory=lambda: np.array([3.0, 1.0]))
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        """Values: length and weight; an exception has weight 0."""
        a = ahocorasick.Automaton()
        words = {fold(w): x for w, x in self.weights.items()} | dict.fromkeys(map(fold, self.exceptions), 0.0)
        for w, x in words.items():
            a.add_word(w, (len(w), x))
        a.make_automaton()
        return a


def matches(automaton: ahocorasick.Automaton, text: str) -> tuple[float, int]:
    """Summed weight and number of the whole words of folded text that match outside exceptions."""
    hits, free = [], []
    n = len(text)
    for end, (size, weight) in automaton.iter(text):
        start = end - size + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < n and text[end + 1].isalnum()):
            continue
        if weight:
            hits.append((start, end, weight))
        else:
            free.append((start, end))
    if free:
        hits = [h for h in hits if not any(x <= h[0] and h[1] <= y for x, y in free)]
    return math.fsum(h[2] for h in hits), len(hits)


def measures(weight: float, words: int) -> tuple[float, float]:
    """Logs of the weight per hundred words and of the whole weight."""
    return math.log1p(100 * weight / max(words, 20)), math.log1p(weight)


def text_score(model: Model, weight: float, words: int) -> float:
    z = model.bias + float(np.dot(model.slope, measures(weight, words)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(fold(text)))


def sketch(text: str) -> list[int]:
    """Four min-hashes of the text's shingles; texts of fewer words are one shingle."""
    words = text.lower().split()
    k = min(SHINGLE, len(words))
    if not k:
        return [0, 0, 0, 0]
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + k])) for i in range(len(words) - k + 1)], np.uint64)
    return [int((h * m).min()) for m in _ODD_FACTORS]


#: Odd factors that permute 64-bit hashes.
_ODD_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def clusters(sketches: list[list[int]]) -> list[int]:
    """A number for each text, equal for texts joined by agreeing in two of their min-hashes."""
    parent = list(range(len(sketches)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple, int] = {}
    for i, s in enumerate(sketches):
        for a, b in combinations(range(len(s)), 2):
            parent[root(i)] = root(first.setdefault((a, b, s[a], s[b]), i))
    return [root(i) for i in range(len(sketches))]


def _sketched(batches):
    for b in batches:
        keys = [sketch(x.decode("utf-8", "replace")) for x in texts_of(b, 2)]
        keys = [[k - (1 << 63) for k in s] for s in keys]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["k", "toxic", "sketch"])


def _entries(batches):
    for b in batches:
        words, toxic, cluster = [], [], []
        for y, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b, 2), strict=True):
            own = words_of(x.decode("utf-8", "replace"))
            words += own
            toxic += [y] * len(own)
            cluster += [c] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32()), pa.array(cluster, pa.int64())], names=["word", "toxic", "cluster"])


def _pairs(weights: dict[str, float]):
    """Neighbouring words of folded text, a blank between them, of which one is in the lexicon."""

    def run(batches):
        for b in batches:
            pairs, toxic, cluster = [], [], []
            for y, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b, 2), strict=True):
                words = list(_WORD.finditer(fold(x.decode("utf-8", "replace"))))
                own = {f"{u[0]} {v[0]}" for u, v in pairwise(words) if u.end() + 1 == v.start() and u.string[u.end()] == " " and (u[0] in weights or v[0] in weights)}
                pairs += own
                toxic += [y] * len(own)
                cluster += [c] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array(toxic, pa.int32()), pa.array(cluster, pa.int64())], names=["word", "toxic", "cluster"])

    return run


def clustered(labelled: DataFrame) -> DataFrame:
    """(toxic, cluster, _qm_b) of (toxic int, text) rows, which the caller has bounded: their sketches are grouped on the driver."""
    spark = labelled.sparkSession
    small_batches(spark)
    texts = labelled.select(F.xxhash64("text").alias("k"), F.col("toxic").cast("int"), F.col("text").cast("binary").alias("_qm_b")).dropDuplicates(["k", "toxic"])
    rows = texts.mapInArrow(_sketched, "k long, toxic int, sketch array<long>").collect()
    rows = sorted({r[0]: r[2] for r in rows}.items())
    group = clusters([s for _, s in rows])
    cluster = spark.createDataFrame([(k, g) for (k, _), g in zip(rows, group, strict=True)], "k long, cluster long")
    return materialize(texts.join(F.broadcast(cluster), "k").select("toxic", "cluster", "_qm_b"), "clustered")


def _weights(own: DataFrame) -> dict[str, float]:
    held = materialize(own.mapInArrow(_entries, "word string, toxic int, cluster long").distinct(), "words")
    n = {r[0]: r[1] for r in held.select("toxic", "cluster").distinct().groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    df = held.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    weight = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good + 1))
    kept = df.where(F.col("bad") >= max(SUPPORT, SUPPORT_SHARE * bad)).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
    return {r["word"]: r["w"] for r in kept.orderBy(F.desc(F.col("w") * F.col("bad")), "word").collect()}


def lexicon(labelled: DataFrame) -> dict[str, float]:
    """Weighted words from (toxic int, text) rows."""
    return _weights(clustered(labelled))


def learned_exceptions(own: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Folded phrases of two words in which a lexicon word is harmless, by the clusters that hold them."""
    if not weights:
        return ()
    held = own.mapInArrow(_pairs(weights), "word string, toxic int, cluster long").distinct()
    df = held.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    kept = df.where((F.col("all") - F.col("bad") >= SUPPORT) & (F.col("bad") + 0.5 <= EXCEPTION_SHARE * (F.col("all") + 1)))
    return tuple(r["word"] for r in kept.orderBy(F.desc("all"), "word").collect())


def _match(model: Model):
    def run(batches):
        a = model.automaton()
        for b in batches:
            weight, n, words = [], [], []
            for x in texts_of(b, b.num_columns - 1):
                w, k = matches(a, fold(x.decode("utf-8", "replace"))) if x else (0.0, 0)
                weight.append(w)
                n.append(k)
                words.append(len(x.split()))
            kept = b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weight, pa.float64()), pa.array(n, pa.int64()), pa.array(words, pa.int64())], names=[*b.schema.names[:-1], "weight", "n_matches", "n_words"])

    return run


def matched(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, weight, n_matches, n_words) of every row; a null text counts as empty."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("binary").alias("_qm_b")).mapInArrow(_match(model), f"{key} {kind}, weight double, n_matches long, n_words long")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton's method with a ridge, the constant last."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, k: int = 3, r: int = 1, rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` labelled whole texts whose crc32(doc_id) mod k is not r."""
    known = labels.where(F.col("toxic").isin(0, 1) & learned_from(k, r)).select("doc_id", "toxic")
    texts = materialize(whole_texts(docs, labelled_rows(docs, known, rows)).select("toxic", F.col("_qm_b").cast("string").alias("text")), "labelled")
    own = clustered(texts)
    model = Model(_weights(own))
    model.exceptions = EXCEPTIONS + learned_exceptions(own, model.weights)
    seen = sorted(matched(texts, model, "toxic").select("weight", "n_words", "toxic").collect())
    if len({s[2] for s in seen}) == 2:
        w = _logistic(np.array([measures(a, b) for a, b, _ in seen]), np.array([s[2] for s in seen], float))
        model.slope, model.bias = np.maximum(w[:2], 0), float(w[2])
    return model


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    s = matched(docs, model)
    rate, whole = F.log1p(100 * F.col("weight") / F.greatest("n_words", F.lit(20))), F.log1p("weight")
    z = F.lit(model.bias) + F.lit(float(model.slope[0])) * rate + F.lit(float(model.slope[1])) * whole
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return s.select("doc_id", held_out(3, 1).alias("held_out"), score.alias("score"), "n_matches").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
