"""Importance resampling towards a target text: hashed word n-grams, weights, and a draw without replacement.

Words get ids, and the suffixes of a block of texts are sorted by their first
three ids: a suffix array as deep as the features are long. Suffixes with a
common prefix of n ids lie side by side, a run of the LCP array, so each n-gram
of a block is hashed once, however often it occurs; counts are the runs'
lengths, and for scoring the run's bucket is scattered back to every occurrence.
A hash of several words is put together from the words' own CRC-32 values by
shift tables, for all runs at once.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.ranking import placed

from .common import KEYS, bounded_broadcast, materialize, row_keys, table, texts_of, with_keys

BUCKETS = 10_000
SEED = 42
#: Documents of fewer words are not drawn; of the others five in a hundred are.
LEAST_WORDS = 20
PERCENT = 5
#: Words in one suffix array, and ids that a task keeps; three ids fill the 63 bits of a sort key.
BLOCK = 1 << 19
ID_BITS = 21
ID_MASK = (1 << ID_BITS) - 1
#: Bytes of a text that are split into words at a time.
SLICE = 4 << 20

#: Bytes between words: ASCII without digits and letters; capitals are lowered before.
BETWEEN = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
SPACED = bytes.maketrans(BETWEEN, b" " * len(BETWEEN))
ENDS = re.compile(rb"[\x00-/:-@\[-`{-\x7f]")


def _shift_tables() -> list[np.ndarray]:
    """For each k, tables by byte of what 2**k zero bytes behind a text do to its CRC-32."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    low = np.arange(256, dtype=np.uint32)
    tables = [np.stack([one, low, low << 8, low << 16])]
    for _ in range(30):
        tables.append(np.stack([_through(tables[-1], t) for t in tables[-1]]))
    return tables


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


SHIFTS = _shift_tables()


def crc_joined(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts joined from those of their halves and the byte lengths of the second."""
    a = a.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        a[at] = _through(SHIFTS[k], a[at])
    return a ^ b


class Vocabulary(dict):
    """Ids of a task's words from 1 on, in the order in which they come, with CRC-32 values and lengths. Id 0 stands between texts."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.crc = self.spaced = np.zeros(1, np.uint32)
        self.length = np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self) + 1
        self.fresh.append(word)
        return i

    def settle(self) -> None:
        """Hash the words that came since the last time; ``spaced`` is the hash of a word and a space."""
        if self.fresh:
            crc = [zlib.crc32(w) for w in self.fresh]
            self.crc = np.concatenate((self.crc, np.array(crc, np.uint32)))
            self.spaced = np.concatenate((self.spaced, np.array([zlib.crc32(b" ", c) for c in crc], np.uint32)))
            self.length = np.concatenate((self.length, np.array([len(w) for w in self.fresh], np.int64)))
            self.fresh = []


def pieces(text: bytes, most: int = BLOCK):
    """(words, counted) of a text's parts: the first ``counted`` words begin features here, up to two more only end them."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + SLICE
        cut = ENDS.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        held += text[at:end].lower().translate(SPACED).split()
        at = end
        while len(held) > most + 2:
            yield held[: most + 2], most
            del held[:most]
    yield held, len(held)


class Block:
    """Texts whose suffixes are sorted together; ``owner`` is the text of each counted position."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids: list[np.ndarray] = []
        self.counted: list[np.ndarray] = []
        self.owner: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes], counted: int, owner: int) -> None:
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        self.ids += [ids, np.zeros(1, np.int64)]
        self.counted.append(self.size + np.arange(counted))
        self.owner.append(np.full(counted, owner))
        self.size += len(words) + 1

    def runs(self):
        """(owner, order, [(bucket hash, start, length) of the runs of n = 1, 2, 3]): runs of a shorter n-gram than n have hash -1."""
        v = self.vocabulary
        v.settle()
        ids = np.concatenate((*self.ids, np.zeros(2, np.int64)))
        at = np.concatenate(self.counted)
        second = ids[at + 1]
        key = ids[at] << 2 * ID_BITS | second << ID_BITS | np.where(second > 0, ids[at + 2], 0)
        order = np.argsort(key)
        key = key[order]
        differ = key[1:] ^ key[:-1]
        out = []
        for n in (1, 2, 3):
            start = np.concatenate(([0], np.flatnonzero(differ >> (3 - n) * ID_BITS) + 1))
            head = key[start]
            w = [head >> 2 * ID_BITS, head >> ID_BITS & ID_MASK, head & ID_MASK][:n]
            if n == 1:
                h = v.crc[w[0]]
            elif n == 2:
                h = crc_joined(v.spaced[w[0]], v.crc[w[1]], v.length[w[1]])
            else:
                h = crc_joined(crc_joined(v.spaced[w[0]], v.spaced[w[1]], v.length[w[1]] + 1), v.crc[w[2]], v.length[w[2]])
            out.append((np.where(w[-1] > 0, h.astype(np.int64), -1), start, np.diff(start, append=len(key))))
        return np.concatenate(self.owner), order, out


def _counted(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        vocabulary = Vocabulary()
        block = Block(vocabulary)

        def close():
            for h, _, n in block.runs()[2]:
                real = h >= 0
                total[:] += np.bincount(h[real] % buckets, weights=n[real], minlength=buckets).astype(np.int64)

        for b in batches:
            for text in texts_of(b, 0):
                for words, counted in pieces(text):
                    if counted:
                        block.add(words, counted, 0)
                    if block.size >= BLOCK:
                        close()
                        vocabulary = vocabulary if len(vocabulary) < BLOCK else Vocabulary()
                        block = Block(vocabulary)
        if block.size:
            close()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: sums of every task's own, so ``buckets`` rows reach the driver."""
    counts = docs.select(F.col("text").cast("binary").alias("_qm_b")).mapInArrow(_counted(buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket a thousand times the logarithm of its smoothed share of the target over that of the raw texts, rounded down."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(raw, target, strict=True)], np.int64)


def noise(doc_id: str, seed: int) -> int:
    """Gumbel noise in thousandths, the same on every run."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain: np.ndarray, seed: int):
    padded = np.append(gain, 0)
    none = len(gain)

    def run(batches):
        vocabulary = Vocabulary()
        for b in batches:
            words_of = np.zeros(b.num_rows, np.int64)
            weight = np.zeros(b.num_rows, np.int64)
            block = Block(vocabulary)

            def close(block=block, weight=weight):
                owner, order, runs = block.runs()
                own = np.zeros(len(order), np.int64)
                at = np.empty(len(order), np.int64)
                for h, _, n in runs:
                    at[order] = np.repeat(np.where(h >= 0, h % none, none), n)
                    own += padded[at]
                total = np.concatenate(([0], np.cumsum(own)))
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                np.add.at(weight, owner[first], total[np.append(first[1:], len(owner))] - total[first])

            for i, text in enumerate(texts_of(b, b.num_columns - 1)):
                for words, counted in pieces(text):
                    if counted:
                        block.add(words, counted, i)
                        words_of[i] += counted
                    if block.size >= BLOCK:
                        close(block)
                        vocabulary = vocabulary if len(vocabulary) < BLOCK else Vocabulary()
                        block = Block(vocabulary)
            if block.size:
                close(block)
            features = words_of + np.maximum(words_of - 1, 0) + np.maximum(words_of - 2, 0)
            luck = np.array([noise(x or "", seed) for x in b.column(0).to_pylist()], np.int64)
            made = [words_of, features, weight, weight + luck]
            yield pa.RecordBatch.from_arrays([*b.columns[1:-1], *map(pa.array, made)], names=[*b.schema.names[1:-1], "n_words", "n_features", "weight", "score"])

    return run


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """Stored (doc_id, _qm_k1, _qm_k2, n_words, n_features, weight, score) of every row; a null text has no word, a null id is drawn by the seed alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.col("doc_id").cast("string").alias("_qm_id"), "doc_id", *row_keys(), F.col("text").cast("binary").alias("_qm_b"))
    out = rows.mapInArrow(_scored(gain, seed), f"doc_id {kind}, {KEYS[0]} long, {KEYS[1]} long, n_words long, n_features long, weight long, score long")
    return materialize(out, "scored")


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` rows with rank: 1, 2, 3... of the drawn by falling score, ties by rising doc_id (null first); else null.

    ``percent`` in a hundred of the rows with enough words are drawn, rounded
    down. Places come from ranges, so no task holds all rows.
    """
    enough = F.col("n_words") >= least_words
    take = percent * rows.where(enough).count() // 100
    places = placed(rows.where(enough), [("score", True), ("doc_id", False), (KEYS[0], False), (KEYS[1], False)], "rank")
    drawn = places.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return drawn.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resampling(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``ranked`` rows of ``docs`` (doc_id, text), weighted towards the texts of ``target`` (text).

    Whole texts count, of any length; an empty text has no feature and weight
    0. Rows equal in doc_id and text are rows of their own with equal scores.
    An empty table of documents gives an empty table, an empty target weighs
    against frequent buckets only. Other columns do not matter.
    """
    return ranked(scored(docs, gains(bucket_counts(docs), bucket_counts(target))))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The drawn rows of ``docs``, columns unchanged, whatever they are called."""
    drawn = resampling(docs, target).where("rank is not null").groupBy(*KEYS).agg(F.count("*").alias("copies"))
    drawn = materialize(drawn, "drawn")
    keyed, names = with_keys(docs)
    extra = "_qm_copies"
    while extra in keyed.columns:
        extra += "_"
    met = keyed.join(bounded_broadcast(drawn.toDF(*names, extra), drawn.count()), names)
    # Rows equal in doc_id and text are told apart only where not all of them were drawn.
    place = F.row_number().over(Window.partitionBy(*names).orderBy(names[0]))
    return met.withColumn(names[0] + "n", place).where(F.col(names[0] + "n") <= F.col(extra)).drop(*names, extra, names[0] + "n")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    out = resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
