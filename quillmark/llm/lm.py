"""Language-model scoring.

Word counts over all training documents give a base score. The model is a
causal self-attention network, trained in numpy, over subword ids grouped in
classes: a context of up to ``SPAN`` ids gives the next class, the class gives
the id. Subword frequencies, the neighbours that group ids and the bigrams of
classes are sums over all training documents; attention weights start on a share
of them and then pass over all, in tasks whose weights are averaged; the mixture
is set on all, each less its own words. Windows overlap by half,
and each scores the ids of its second half, so that every id is scored once
with at least half a window of context.

``score`` is a log probability. Ids that begin a word start with a space and
have classes of their own, so the network's probability of a word is that of
its ids, the first given that a word begins, times that of a word or the end
beginning next; over all words and the end these sum to 1. It is mixed with the
probability of the word counts, in which all words never seen are one event, as
in the base: in the task for the words frequent enough to be sent there, after
a join for all others.

A null text is an empty one, whose only token is its end; long texts are scored
whole; repeated rows score alike and count each; an empty table gives an empty
one, and with nothing to learn from all words are equally unlikely.
"""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import as_strided
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEYS, discard, held_out, learned_from, materialize, row_keys, small_batches, table, texts_of

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: A text's words and its end; no word contains a line end.
END = b"\n"
#: Words whose counts every task holds; the others' counts come by a join.
HEAD_WORDS = 200_000
#: Share of the training documents on which the attention starts, before it passes over all, and the least number of texts.
TRAIN_SHARE, LEAST_TEXTS = 1 / 256, 500
#: Texts of an Arrow batch whose words are counted.
COUNT_ROWS = 4096
#: Texts of one training task.
TASK_TEXTS = 500
#: Nats in a bin of the histogram that sets the mixture.
GAP_BIN = 0.01
#: Classes: padding, start, end, ids of their own, groups of ids that begin a word and of others, and two for rare ids.
CLASSES, OWN_CLASSES, BEGIN_GROUPS = 64, 40, 10
WIDTH, SPAN = 16, 32
HALF = SPAN // 2
EPOCHS = 4
PAD, START, STOP = 0, 1, 2
RARE_BEGIN, RARE = CLASSES - 2, CLASSES - 1
#: Windows scored at a time, few enough that their arrays stay in a core's cache.
BLOCK = 128


@lru_cache(2)
def tokenizer(path: str = TOKENIZER):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def begins(path: str = TOKENIZER) -> np.ndarray:
    """By subword id: whether it begins a word, which is to start with a space."""
    enc = tokenizer(path)
    return np.fromiter((enc.decode_single_token_bytes(i)[:1] == b" " for i in range(enc.n_vocab)), bool, enc.n_vocab)


def _alone(path: str, word: bytes) -> list[int]:
    """Subwords of one word; bytes that are no UTF-8 are an id each."""
    enc = tokenizer(path)
    try:
        return enc.encode_ordinary(" " + word.decode())
    except UnicodeDecodeError:
        return [enc.encode_single_token(bytes((c,))) for c in b" " + word]


def subwords(words: list[bytes], path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of ``words``, one after another, and the number of each word's: all are encoded in one call."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    try:
        ids = tokenizer(path).encode_to_numpy((b" " + b" ".join(words)).decode(), disallowed_special=()).astype(np.int64)
        first = np.flatnonzero(begins(path)[ids])
    except UnicodeDecodeError:
        first = ()
    if len(first) != len(words):
        one = [_alone(path, w) for w in words]
        return np.array([i for x in one for i in x], np.int64), np.array([len(x) for x in one], np.int64)
    return ids, np.diff(first, append=len(ids))


def split_words(texts: pa.Array | list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, one after another, and the number of each text's."""
    texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
    lower = pc.ascii_lower(pc.fill_null(pc.cast(texts, pa.string(), safe=False), ""))
    split = pc.ascii_split_whitespace(lower)
    words = split.flatten().cast(pa.binary())
    # White space at a text's ends leaves empty words.
    real = pc.greater(pc.binary_length(words), 0)
    ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return words.filter(real).dictionary_encode(), np.diff(before[ends], prepend=0)


@dataclass
class Tokens:
    """Tokens of several texts: the distinct ones, with the end of a text first, and their numbers in order."""

    distinct: list[bytes]
    ids: np.ndarray
    sizes: np.ndarray  # of each text, its end counted

    @classmethod
    def of(cls, texts: pa.Array | list[bytes]) -> Tokens:
        coded, sizes = split_words(texts)
        ids = np.zeros(len(coded) + len(sizes), np.int64)
        ids[np.arange(len(coded)) + np.repeat(np.arange(len(sizes)), sizes)] = coded.indices.to_numpy() + 1
        return cls([END, *coded.dictionary.to_numpy(zero_copy_only=False).tolist()], ids, sizes + 1)


# ---- word counts -------------------------------------------------------------


def _count(batches):
    for b in batches:
        if b.num_rows:
            coded, sizes = split_words(b.column(0))
            c = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(c, len(sizes)))], names=["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c) over all rows of ``docs``, the end of each text among the words."""
    small_batches(docs.sparkSession, COUNT_ROWS)
    part = docs.select(F.col("text").cast("binary").alias("_qm_b")).mapInArrow(_count, "word binary, c long")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


def head_counts(counts: DataFrame, most: int = HEAD_WORDS) -> dict[bytes, int]:
    """The most frequent words: all above the least count that keeps them within ``most``."""
    step = F.floor(F.log2("c") * 4).cast("int")
    sizes = dict(counts.groupBy(step.alias("s")).count().collect())
    total, least = 0, None
    for s in sorted(sizes, reverse=True):
        total += sizes[s]
        if total > most:
            break
        least = s
    if least is None:
        return {}
    rows = counts.where(step >= least).toArrow()
    return dict(zip(rows["word"].to_pylist(), rows["c"].to_pylist(), strict=True))


# ---- the network -------------------------------------------------------------


@dataclass
class Network:
    """Single-layer attention over classes; a class's query, key and value are rows of tables."""

    query: np.ndarray  # (CLASSES, WIDTH)
    key: np.ndarray
    value: np.ndarray
    place: np.ndarray  # (SPAN,): added to the attention logit at each distance
    own: np.ndarray  # (CLASSES, CLASSES): logits from the last class alone
    out: np.ndarray  # (WIDTH, CLASSES)

    def parts(self) -> list[np.ndarray]:
        return [self.query, self.key, self.value, self.place, self.own, self.out]


@dataclass
class Model:
    network: Network
    class_of: np.ndarray  # by subword id
    emit: np.ndarray  # log probability of a subword id within its class
    share: float  # of the word counts in the mixture
    path: str = TOKENIZER


@dataclass
class Layout:
    """Sequences of classes laid out so that the windows are rows of overlapping halves.

    Each sequence stands behind ``HALF`` paddings and a start; window w of it
    reads ``SPAN`` places from its w-th half on and scores the classes one place
    behind its second half.
    """

    flat: np.ndarray  # (places,) uint8, padded to whole halves
    rows: np.ndarray  # half at which each window begins
    sizes: np.ndarray
    firsts: np.ndarray  # of each sequence: its first window times HALF

    @classmethod
    def of(cls, classes: np.ndarray, sizes: np.ndarray) -> Layout:
        per = -(-sizes // HALF)
        halves = per + 2
        at = (np.cumsum(halves) - halves) * HALF
        flat = np.full(int(halves.sum()) * HALF, PAD, np.uint8)
        flat[at + HALF] = START
        flat[np.arange(len(classes)) + np.repeat(at + HALF + 1 - (np.cumsum(sizes) - sizes), sizes)] = classes
        firsts = np.cumsum(per) - per
        return cls(flat, np.arange(int(per.sum())) + np.repeat(2 * np.arange(len(sizes)), per), sizes, firsts * HALF)

    def block(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Context (n, SPAN) and scored classes (n, HALF) of the windows a to b."""
        at = self.rows[a:b, None] * HALF
        return self.flat[at + np.arange(SPAN)].astype(np.int64), self.flat[at + (HALF + 1 + np.arange(HALF))].astype(np.int64)

    def places(self) -> np.ndarray:
        """Of each class where the half that scores it would have it, were a window to begin at each half."""
        halves = -(-self.sizes // HALF) + 2
        return np.arange(int(self.sizes.sum())) + np.repeat((np.cumsum(halves) - halves) * HALF - (np.cumsum(self.sizes) - self.sizes), self.sizes)

    def spots(self) -> np.ndarray:
        """Of each class its place among all windows' scored ones."""
        return np.arange(int(self.sizes.sum())) + np.repeat(self.firsts - (np.cumsum(self.sizes) - self.sizes), self.sizes)


def windows(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context classes (n, SPAN), the classes to score (n, HALF), and the place of each in ``classes`` (-1: none).

    ``classes`` holds the sequences one after another. The context of position
    t ends with t - 1; a start stands before each sequence.
    """
    laid = Layout.of(classes, sizes)
    context, target = laid.block(0, len(laid.rows))
    spot = np.full(target.size, -1, np.int64)
    spot[laid.spots()] = np.arange(len(classes))
    spot = spot.reshape(target.shape)
    return context, np.where(spot >= 0, target, PAD), spot


#: Distance of key j from the query of target i, and where it is causal.
_DISTANCE = np.arange(HALF)[:, None] + HALF - np.arange(SPAN)[None, :]
_CAUSAL = (_DISTANCE >= 0) & (_DISTANCE < SPAN)
_PLACE = np.clip(_DISTANCE, 0, SPAN - 1)


class Room(dict):
    """Arrays by name that are used again and again, so that blocks of windows ask for no new memory."""

    def __call__(self, name: str, shape: tuple[int, ...], dtype: type = np.float32) -> np.ndarray:
        size, held = math.prod(shape), self.get(name)
        if held is None or len(held) < size:
            held = self[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)


def _weights(pair: np.ndarray, mask: np.ndarray, last: np.ndarray, ctx: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the table of pairs (n, HALF, SPAN), and attention weights, not yet divided by their sums."""
    shape, dtype = (len(ctx), HALF, SPAN), pair.dtype.type
    cells = np.add((last * CLASSES)[:, :, None], ctx[:, None, :], out=room("cells", shape, np.int64))
    weight = pair.reshape(-1).take(cells, out=room("weight", shape, dtype), mode="clip")
    weight *= mask
    return cells, weight


def _tables(net: Network, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits of pairs and of places, masked ones 0."""
    pair = net.query @ net.key.T
    pair = np.exp(np.clip(pair, -20, 20, out=pair), out=pair).astype(dtype, copy=False)
    pair[:, PAD] = 0
    mask = (np.exp(np.clip(net.place, -20, 20))[_PLACE] * _CAUSAL).astype(dtype, copy=False)
    return pair, mask


class Scorer:
    """Attention weights from tables of exponentials: masked positions weigh 0.

    ``begin`` marks the classes that begin a word, the end among them.
    """

    def __init__(self, net: Network, begin: np.ndarray | None = None):
        self.pair, self.mask = _tables(net, np.float32)
        # A last column of ones sums the weights.
        self.value = np.column_stack((net.value, np.ones(CLASSES))).astype(np.float32)
        self.own, self.out = (np.ascontiguousarray(x, np.float32) for x in (net.own, net.out))
        begin = np.zeros(CLASSES, bool) if begin is None else begin
        self.sums, self.room = np.column_stack((np.ones(CLASSES), begin)).astype(np.float32), Room()

    def __call__(self, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log probability of each class given those before it in its sequence."""
        return self.both(classes, sizes)[0]

    def both(self, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``__call__``, and the log probability that a word, or the end, begins at each place.

        A window begins at each half, those that reach into the next sequence
        among them, whose results are not used: so windows are views of values
        that stand one after another.
        """
        laid, room = Layout.of(classes, sizes), self.room
        halves = len(laid.flat) // HALF
        # What is scored stands one place behind its half.
        flat = np.append(laid.flat, np.uint8(PAD))
        chance, start = np.empty((2, halves * HALF), np.float32)
        for a in range(0, halves - 1, BLOCK):
            n = min(BLOCK, halves - 1 - a)
            here = flat[a * HALF : (a + n + 1) * HALF].astype(np.int64)
            last, tgt = here[HALF:], flat[(a + 1) * HALF + 1 : (a + n + 1) * HALF + 1].astype(np.int64)
            step = here.itemsize * HALF
            ctx = as_strided(here, (n, SPAN), (step, here.itemsize), writeable=False)
            _, weight = _weights(self.pair, self.mask, last.reshape(n, HALF), ctx, room)
            value = self.value.take(here, axis=0, out=room("value", (len(here), WIDTH + 1)), mode="clip")
            value = as_strided(value, (n, SPAN, WIDTH + 1), (HALF * value.strides[0], *value.strides), writeable=False)
            seen = np.matmul(weight, value, out=room("seen", (n, HALF, WIDTH + 1))).reshape(-1, WIDTH + 1)
            mean = np.divide(seen[:, :WIDTH], seen[:, WIDTH:] + np.float32(1e-9), out=room("mean", (n * HALF, WIDTH)))
            logits = np.matmul(mean, self.out, out=room("logits", (n * HALF, CLASSES)))
            logits += self.own.take(last, axis=0, out=room("own", (n * HALF, CLASSES)), mode="clip")
            chosen = logits.reshape(-1).take(np.arange(0, n * HALF * CLASSES, CLASSES) + tgt)
            np.exp(logits, out=logits)
            total, first = np.log(logits @ self.sums + np.float32(1e-30)).T
            at = slice(a * HALF, (a + n) * HALF)
            np.subtract(chosen, total, out=chance[at])
            np.subtract(first, total, out=start[at])
        at = laid.places()
        return chance[at], start[at]


def _ordered(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by class, the classes that occur, and where each begins in that order."""
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    sizes = np.bincount(classes, minlength=CLASSES)
    some = np.flatnonzero(sizes)
    return order, some, (np.cumsum(sizes) - sizes)[some]


def _run_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; neighbours in a row are added as one complex number, in half as many loops."""
    pairs = rows.view(np.complex64 if rows.dtype == np.float32 else np.complex128)
    return np.add.reduceat(pairs, starts, axis=0).view(rows.dtype)


#: The largest logit in training, so that exponentials stay finite.
_MOST = 60


def _gradients(net: Network, ctx: np.ndarray, tgt: np.ndarray, at: np.ndarray, room: Room | None = None, lossless: bool = False) -> tuple[float, list[np.ndarray]]:
    """The loss of a batch of windows, unless ``lossless``, and its slopes.

    The attention's slopes come by pairs of classes. Places are in the order of
    their last class where the next class's law is concerned, so that rows of
    one class are summed as they stand.
    """
    room, dtype, windows = Room() if room is None else room, net.own.dtype.type, len(ctx)
    rows, last = windows * HALF, ctx[:, HALF:]
    pair, mask = _tables(net, dtype)
    cells, att = _weights(pair, mask, last, ctx, room)
    # Weights are divided by their sums where they meet a place's mean and its slope.
    sums = (1 / (att.reshape(rows, SPAN) @ np.ones(SPAN, dtype) + dtype(1e-9)))[:, None]
    v = net.value.take(ctx, axis=0, out=room("value", (windows, SPAN, WIDTH), dtype), mode="clip")
    seen = np.matmul(att, v, out=room("seen", (windows, HALF, WIDTH), dtype)).reshape(rows, WIDTH)
    seen *= sums
    last = last.ravel()
    order, some, starts = _ordered(last)
    back = room("back", (rows,), np.int64)
    back[order] = np.arange(rows)
    mean = seen.take(order, axis=0, out=room("mean", (rows, WIDTH), dtype), mode="clip")
    p = np.matmul(mean, net.out, out=room("p", (rows, CLASSES), dtype))
    p += net.own.take(last.take(order), axis=0, out=room("own", (rows, CLASSES), dtype), mode="clip")
    # Means lie within their values, so most nets can't have a logit that large.
    if not np.abs(net.value).max(axis=0) @ np.abs(net.out).max(axis=1) + net.own.max() < _MOST:
        np.minimum(p, _MOST, out=p)
    np.exp(p, out=p)
    total = 1 / (p @ np.ones(CLASSES, dtype))
    chosen, share = np.arange(0, rows * CLASSES, CLASSES) + tgt.ravel().take(order), (at.ravel().take(order) >= 0).astype(dtype)
    flat, n = p.reshape(-1), max(1, np.count_nonzero(share))
    loss = math.nan if lossless else -(np.log(flat.take(chosen) * total + dtype(1e-12)) @ share) / n
    share /= dtype(n)
    p *= (share * total)[:, None]
    flat[chosen] -= share
    d_own = np.zeros((CLASSES, CLASSES), dtype)
    d_own[some] = _run_sums(p, starts)
    slope = np.matmul(p, net.out.T, out=room("slope", (rows, WIDTH), dtype))
    d_out = mean.T @ p
    d_seen = slope.take(back, axis=0, out=room("d_seen", (rows, WIDTH), dtype), mode="clip")
    d_seen *= sums
    common = np.einsum("ij,ij->i", d_seen, seen)
    d_seen = d_seen.reshape(windows, HALF, WIDTH)
    d_log = np.matmul(d_seen, v.transpose(0, 2, 1), out=room("d_log", att.shape, dtype))
    d_log -= common.reshape(windows, HALF, 1)
    d_log *= att
    d_pair = np.bincount(cells.reshape(-1), d_log.reshape(-1), CLASSES * CLASSES).reshape(CLASSES, CLASSES).astype(dtype)
    d_place = np.bincount(_PLACE.reshape(-1), np.ones(windows, dtype) @ d_log.reshape(windows, -1), SPAN).astype(dtype)
    of_key = np.matmul(att.transpose(0, 2, 1), d_seen, out=room("of_key", (windows, SPAN, WIDTH), dtype)).reshape(-1, WIDTH)
    order, some, starts = _ordered(ctx.reshape(-1))
    d_value = np.zeros((CLASSES, WIDTH), dtype)
    d_value[some] = _run_sums(of_key.take(order, axis=0, out=room("by_key", of_key.shape, dtype), mode="clip"), starts)
    return loss, [d_pair @ net.key, d_pair.T @ net.query, d_value, d_place, d_own, d_out]


def pair_counts(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(CLASSES, CLASSES): how often the second class follows the first; a start stands before each sequence."""
    before = np.concatenate(([START], classes[:-1]))
    before[np.cumsum(sizes) - sizes] = START
    return np.bincount(before * CLASSES + classes, minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)


_SHAPES = [(CLASSES, WIDTH), (CLASSES, WIDTH), (CLASSES, WIDTH), (SPAN,), (CLASSES, CLASSES), (WIDTH, CLASSES)]


@dataclass
class Training:
    """A network's weights, one after another, and the moments of Adam."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: float = 0.0

    @property
    def net(self) -> Network:
        """The weights as the network's tables."""
        ends = np.cumsum([int(np.prod(x)) for x in _SHAPES])
        return Network(*(x.reshape(shape) for x, shape in zip(np.split(self.weights, ends[:-1]), _SHAPES, strict=True)))

    def vector(self) -> np.ndarray:
        return np.concatenate([self.weights, self.first, self.second, [self.step]])

    def set(self, vector: np.ndarray) -> None:
        n = len(self.weights)
        for i, x in enumerate((self.weights, self.first, self.second)):
            x[:] = vector[i * n : (i + 1) * n]
        self.step = float(vector[-1])

    def epoch(self, classes: np.ndarray, sizes: np.ndarray, number: int, epochs: int, rng: np.random.Generator) -> int:
        """Adam over shuffled windows, whose number is returned."""
        context, target, spot = windows(classes, sizes)
        order, batch = rng.permutation(len(context)), 64
        net, room, x, y = self.net, Room(), self.first, self.second
        g, t = np.empty((2, len(x)), x.dtype)
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            _, grads = _gradients(net, context.take(some, axis=0), target.take(some, axis=0), spot.take(some, axis=0), room, lossless=True)
            np.concatenate([d.ravel() for d in grads], out=g)
            self.step += 1
            lr = 0.01 * (1 - (number + a / len(order)) / epochs)
            # x += 0.1 * (g - x), y += 0.01 * (g * g - y), in place.
            x += np.multiply(np.subtract(g, x, out=t), 0.1, out=t)
            np.multiply(g, g, out=t)
            y += np.multiply(np.subtract(t, y, out=t), 0.01, out=t)
            np.sqrt(np.divide(y, 1 - 0.99**self.step, out=t), out=t)
            t += 1e-8
            self.weights -= np.divide(np.multiply(x, lr / (1 - 0.9**self.step), out=g), t, out=t)
        return len(order)


def new_training(pairs: np.ndarray, seed: int = 5, dtype: type = np.float64) -> Training:
    """Class bigrams are where the table of the last class starts; without any, the network is uniform."""
    rng = np.random.default_rng(seed)
    n = lambda *s: rng.normal(0, 0.3, s)
    net = Network(n(CLASSES, WIDTH), n(CLASSES, WIDTH), n(CLASSES, WIDTH), np.zeros(SPAN), np.zeros((CLASSES, CLASSES)), n(WIDTH, CLASSES) * 0.3)
    if pairs.any():
        net.own[:] = np.log((pairs + 0.1) / (pairs + 0.1).sum(axis=1, keepdims=True))
    else:
        net.out[:] = 0
    weights = np.concatenate([p.ravel() for p in net.parts()]).astype(dtype)
    return Training(weights, *(np.zeros_like(weights) for _ in range(2)))


def train_network(classes: np.ndarray, sizes: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Train in this process."""
    if not len(classes):
        return new_training(np.zeros((CLASSES, CLASSES))).net
    training, rng = new_training(pair_counts(classes, sizes), seed), np.random.default_rng(seed)
    for e in range(epochs):
        training.epoch(classes, sizes, e, epochs, rng)
    return training.net


def own_classes(count: np.ndarray) -> np.ndarray:
    """The ids that are classes of their own, the most frequent first; ``count`` has one more than was seen."""
    order = np.argsort(-count, kind="stable")[:OWN_CLASSES]
    return order[count[order] > 1]


def subword_classes(count: np.ndarray, near: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and log probability within it of each id.

    The most frequent ids are classes of their own; the others, those that
    ``begin`` a word apart from the rest, are grouped by what precedes and
    follows them, ``near`` (k-means on square roots).
    """
    own = own_classes(count)
    class_of = np.where(begin, RARE_BEGIN, RARE)
    class_of[own] = 3 + np.arange(len(own))
    base = 3 + OWN_CLASSES
    order = np.argsort(-count, kind="stable")[len(own) :]
    for which, first, groups in ((begin, base, BEGIN_GROUPS), (~begin, base + BEGIN_GROUPS, RARE_BEGIN - base - BEGIN_GROUPS)):
        rest = order[(count[order] >= 4) & which[order]]
        if len(rest) <= groups:
            class_of[rest] = first + np.arange(len(rest))
            continue
        about = near[rest].astype(np.float32)
        about = np.sqrt(about / np.maximum(about.sum(axis=1, keepdims=True), 1))
        centres = about[:groups].copy()
        for _ in range(15):
            mine = (about @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            for g in range(groups):
                if (mine == g).any():
                    centres[g] = about[mine == g].mean(axis=0)
        class_of[rest] = first + mine
    size = np.bincount(class_of, count, CLASSES)
    return class_of, np.log(count / size[class_of])


def begin_classes(class_of: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The classes of which a word, or the end, begins."""
    out = np.zeros(CLASSES, bool)
    out[class_of[begin]] = True
    out[STOP] = True
    return out


# ---- words to subwords -------------------------------------------------------


@dataclass
class Head:
    """The most frequent words, whose counts and subwords every task gets, so that none encodes them anew."""

    words: list[bytes]
    counts: np.ndarray
    flat: np.ndarray  # subword ids, one word after another
    lengths: np.ndarray

    @classmethod
    def of(cls, counts: dict[bytes, int], path: str = TOKENIZER) -> Head:
        words, coder = list(counts), Subwords(path)
        coder.learn(words)
        return cls(words, np.fromiter(counts.values(), np.int64, len(words)), coder.flat, coder.lengths)


class Subwords:
    """Subwords of words: those of the head, and behind them those of the last texts' other words."""

    def __init__(self, path: str = TOKENIZER, head: Head | None = None):
        self.path, self.head = path, head or Head([], np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))
        self.numbers = {w: i for i, w in enumerate(self.head.words)}

    def learn(self, words: list[bytes]) -> None:
        """Encode words outside the head in place of those learned before; the end is an id behind the vocabulary."""
        plain = [w for w in words if w != END]
        ids, sizes = subwords(plain, self.path)
        if len(plain) < len(words):
            at = words.index(END)
            ids = np.insert(ids, int(sizes[:at].sum()), tokenizer(self.path).n_vocab)
            sizes = np.insert(sizes, at, 1)
        self.flat = np.concatenate((self.head.flat, ids.astype(np.int32)))
        self.lengths = np.concatenate((self.head.lengths, sizes))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def words(self, tokens: Tokens) -> np.ndarray:
        """The number of each token's word."""
        numbers = np.fromiter(map(self.numbers.get, tokens.distinct, repeat(-1)), np.int64, len(tokens.distinct))
        others = np.flatnonzero(numbers < 0)
        numbers[others] = len(self.numbers) + np.arange(len(others))
        self.learn([tokens.distinct[i] for i in others.tolist()])
        return numbers[tokens.ids]

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The subword ids of all ``words``, one after another."""
        sizes = self.lengths[words]
        return self.flat[np.arange(int(sizes.sum())) + np.repeat(self.starts[words] - (np.cumsum(sizes) - sizes), sizes)]

    def __call__(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text's."""
        tokens = Tokens.of(texts)
        words = self.words(tokens)
        ids = self.ids(words)
        return ids, np.add.reduceat(self.lengths[words], np.cumsum(tokens.sizes) - tokens.sizes) if len(ids) else np.zeros(len(tokens.sizes), np.int64)


class Coder(Subwords):
    """Subword ids of texts, each text's end being the id behind the vocabulary."""

    def __init__(self, path: str, head: Head | None = None):
        super().__init__(path, head)
        self.enc = tokenizer(path)


class Words(Subwords):
    """Scores texts; the counts of the words of ``head`` are known here."""

    def __init__(self, model: Model, head: dict[bytes, int] | Head, n: int, types: int):
        self.model, self.floor = model, -np.log10(n + types + 1)
        self.scorer = Scorer(model.network, begin_classes(model.class_of, begins(model.path)))
        self.class_of = np.append(model.class_of, STOP).astype(np.uint8)
        self.emit = np.append(model.emit, 0.0)
        super().__init__(model.path, head if isinstance(head, Head) else Head.of(head, model.path))

        self.head_emitted = self._emitted(self.head.flat, self.head.lengths)

    def _emitted(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.emit[ids], np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)

    def learn(self, words: list[bytes]) -> None:
        """The count of a word outside the head is -1."""
        super().learn(words)
        self.emitted = np.concatenate((self.head_emitted, self._emitted(self.flat[len(self.head.flat) :], self.lengths[len(self.head.words) :])))
        self.counts = np.concatenate((self.head.counts, np.full(len(words), -1)))

    def score(self, texts: pa.Array | list[bytes]) -> dict[str, list | np.ndarray]:
        """By text: n_tokens, head_known, head_log; by token: its number among ``distinct``, network, outside (the head) and counts."""
        tokens = Tokens.of(texts)
        words, sizes = self.words(tokens), tokens.sizes
        starts, counts, lengths = np.cumsum(sizes) - sizes, self.counts[words], self.lengths[words]
        in_head = counts >= 0
        pieces = np.cumsum(lengths) - lengths
        chance, begin = self.scorer.both(self.class_of[self.ids(words)], np.add.reduceat(lengths, starts))
        begin = begin[pieces].astype(np.float64)
        # Given that a word begins, and with the next one, or the end, beginning behind it; nothing follows the end.
        network = np.add.reduceat(chance.astype(np.float64), pieces) + self.emitted[words] - begin
        after = np.append(begin[1:], 0.0)
        after[starts + sizes - 1] = 0
        network = (network + after) / np.log(10)
        logs = np.where(in_head, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
        sums = lambda x: np.add.reduceat(x, starts)
        return {
            "n_tokens": sizes, "head_known": sums(in_head.astype(np.int64)), "head_log": sums(logs),
            "distinct": tokens.distinct, "ids": tokens.ids, "network": network, "outside": ~in_head, "counts": counts, "starts": starts,
        }


def mixture(share: float, network: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """log10 of the mixture of two probabilities, given as log10."""
    ten = np.log(10)
    return np.logaddexp(network * ten + np.log1p(-share), unigram * ten + np.log(share)) / ten


#: Nats beyond which gaps are alike to the mixture, and how many bins of ``GAP_BIN`` lead there.
MOST_GAP = 60
_BINS = round(MOST_GAP / GAP_BIN)

_NETWORKED = "row long, learns boolean, n_tokens long, head_known long, head_log double, gaps array<float>, tail array<binary>, nets array<double>, own array<long>, bins array<int>, k array<long>"


def _networked(model: Model, head: Head, n: int, types: int):
    def lists(at: np.ndarray, starts: np.ndarray, *values: pa.Array | np.ndarray) -> list[pa.ListArray]:
        """By text what stands at the tokens ``at``."""
        offsets = pa.array(np.append(np.searchsorted(at, starts), len(at)).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in values]

    def run(batches):
        words = Words(model, head, n, types)
        row, floor = TaskContext.get().partitionId() << 40, np.log(n + types + 1)
        for b in batches:
            if not b.num_rows:
                continue
            s = words.score(b.column(1))
            inside, outside, starts = np.flatnonzero(~s["outside"]), np.flatnonzero(s["outside"]), s["starts"]
            # How often the text holds the word.
            text = np.repeat(np.arange(b.num_rows), s["n_tokens"])
            pairs = pa.array(text * len(s["distinct"]) + s["ids"]).dictionary_encode().indices.to_numpy()
            own = np.bincount(pairs)[pairs]
            # The gap between both log probabilities: with all counts, and in bins with those of the other texts.
            net, counts = s["network"][inside] * np.log(10) + floor, s["counts"][inside]
            (gaps,) = lists(inside, starts, (net - np.log(counts + 1.0)).astype(np.float32))
            learns = b.column(2).to_numpy(zero_copy_only=False)
            mine = learns[text[inside]]
            other = net[mine] - np.log(np.maximum(counts - own[inside], 0)[mine] + 1.0)
            k = np.bincount(np.rint(np.clip(other, -MOST_GAP, MOST_GAP) / GAP_BIN).astype(np.int64) + _BINS)
            bins = np.flatnonzero(k)
            tail = lists(outside, starts, pa.array(s["distinct"], pa.binary()).take(pa.array(s["ids"][outside])), s["network"][outside], own[outside])
            # The first row has the bins of its whole batch.
            binned = lists(np.zeros(len(bins), np.int64), np.arange(b.num_rows), (bins - _BINS).astype(np.int32), k[bins])
            named = [pa.array(np.arange(row, row + b.num_rows)), b.column(2), *(pa.array(s[x]) for x in ("n_tokens", "head_known", "head_log"))]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), *named, gaps, *tail, *binned], names=["doc_id", *(x.split()[0] for x in _NETWORKED.split(", "))])

    return run


def networked(docs: DataFrame, learns: Column, model: Model, head: Head, n: int, types: int) -> DataFrame:
    """What ``docs`` need of the network, stored: all that remains to be known is the share of the word counts.

    By row: the gaps between both log probabilities of its words of ``head``;
    tail, nets and own of its other words, whose counts are elsewhere. Bins
    count the gaps of the words of ``head`` of rows that ``learns`` is true of.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    part = docs.select("doc_id", F.col("text").cast("binary").alias("_qm_b"), F.coalesce(learns, F.lit(False)).alias("learns"))
    return materialize(part.mapInArrow(_networked(model, head, n, types), f"doc_id {kind}, {_NETWORKED}"), "networked")


def counted_tail(part: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, learns, net, own, c) of each token outside the head, stored; c is null for a word never counted."""
    tail = part.select("row", "learns", F.explode(F.arrays_zip(F.col("tail").alias("word"), F.col("nets").alias("net"), "own")).alias("t")).select("row", "learns", "t.*")
    # Each word has one row in counts, so a partition's table of them is small, and nothing is sorted.
    return materialize(tail.join(counts.hint("shuffle_hash"), "word", "left").drop("word"), "tail")


def _mixed(share: float):
    """Sums over the gaps of each row: what the mixture adds to the word counts' log10 probability."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                gaps = b.column(1)
                added = mixture(share, gaps.flatten().to_numpy(zero_copy_only=False).astype(np.float64) / np.log(10), 0.0)
                ends = np.cumsum(pc.list_value_length(gaps).to_numpy(zero_copy_only=False))
                before = np.bincount(np.repeat(np.arange(b.num_rows), np.diff(ends, prepend=0)), added, b.num_rows).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(before)], names=[*(b.schema.names[i] for i in (0, *range(2, b.num_columns))), "added"])

    return run


# ---- fitting and scoring -----------------------------------------------------


def mixed_column(share: float, network: Column, unigram: Column) -> Column:
    """log10 of the mixture of two probabilities, given as log10; the unigram one never vanishes."""
    return F.log10(F.lit(share) * F.pow(F.lit(10.0), unigram) + F.lit(1 - share) * F.pow(F.lit(10.0), network))


def _cells(array: np.ndarray, names: list[str], rows: int = 200_000):
    """(cell, value) of what is not 0, in batches."""
    at = np.flatnonzero(array)
    for a in range(0, len(at), rows):
        some = at[a : a + rows]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(array[some])], names=names)


def _summed(df: DataFrame, cells: int) -> np.ndarray:
    """Sums of the tasks' (cell, n); the result's size is fixed, whatever the input."""
    rows = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.float64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def subword_counts(counts: DataFrame, path: str = TOKENIZER) -> np.ndarray:
    """One more than each subword's number in the training documents: a word's subwords count as often as the word."""

    def run(batches):
        total = np.zeros(tokenizer(path).n_vocab, np.int64)
        for b in batches:
            some = [(w, c) for w, c in zip(texts_of(b, 0), b.column(1).to_pylist(), strict=True) if w != END]
            ids, sizes = subwords([w for w, _ in some], path)
            np.add.at(total, ids, np.repeat([c for _, c in some], sizes) if some else 0)
        yield from _cells(total, ["cell", "n"])

    small_batches(counts.sparkSession, 10_000)
    return _summed(counts.select("word", "c").mapInArrow(run, "cell int, n long"), tokenizer(path).n_vocab) + 1


def coded(training: DataFrame, path: str = TOKENIZER, head: Head | None = None) -> DataFrame:
    """(ids binary): the subword ids of each text, 4 bytes each, its end behind them."""

    def run(batches):
        coder = Coder(path, head)
        for b in batches:
            if b.num_rows:
                ids, sizes = coder(b.column(0))
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes) * 4)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(ids, np.int32))])], names=["ids"])

    small_batches(training.sparkSession)
    return training.select(F.col("text").cast("binary").alias("_qm_b")).mapInArrow(run, "ids binary")


def _coded_batches(batches):
    """(ids, sizes) of each batch that ``coded`` gave."""
    for b in batches:
        if b.num_rows:
            col = b.column(0)
            ids = np.frombuffer(b"".join(col.to_numpy(zero_copy_only=False).tolist()), np.int32).astype(np.int64)
            yield ids, pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def neighbours(training: DataFrame, own: np.ndarray, path: str = TOKENIZER) -> np.ndarray:
    """(id, what precedes | what follows): numbers over all of ``training``, texts or ``coded`` ones; ids outside ``own`` are one column."""
    vocabulary, width = tokenizer(path).n_vocab, OWN_CLASSES + 1

    def run(batches):
        column = np.full(vocabulary + 1, OWN_CLASSES)
        column[own] = np.arange(len(own))
        total = np.zeros(vocabulary * 2 * width, np.int64)
        for ids, _ in _coded_batches(batches):
            inside = (ids[:-1] < vocabulary) & (ids[1:] < vocabulary)
            left, right = ids[:-1][inside], ids[1:][inside]
            cl, cr = column[left], column[right]
            for me, mine, other in ((right, cr, cl), (left, cl, cr + width)):
                grouped = mine == OWN_CLASSES
                np.add.at(total, me[grouped] * (2 * width) + other[grouped], 1)
        yield from _cells(total, ["cell", "n"])

    rows = training if training.columns == ["ids"] else coded(training, path)
    small_batches(training.sparkSession)
    return _summed(rows.mapInArrow(run, "cell int, n long"), vocabulary * 2 * width).reshape(vocabulary, 2 * width)


def class_pairs(training: DataFrame, class_of: np.ndarray, path: str = TOKENIZER) -> np.ndarray:
    """Bigrams of classes over all of ``training``, texts or ``coded`` ones, starts and ends included."""
    classes = np.append(class_of, STOP)

    def run(batches):
        total = np.zeros((CLASSES, CLASSES), np.int64)
        for ids, sizes in _coded_batches(batches):
            total += pair_counts(classes[ids], sizes)
        yield from _cells(total.ravel(), ["cell", "n"])

    rows = training if training.columns == ["ids"] else coded(training, path)
    small_batches(training.sparkSession)
    return _summed(rows.mapInArrow(run, "cell int, n long"), CLASSES * CLASSES).reshape(CLASSES, CLASSES)


def shares(training: DataFrame, rows: int) -> tuple[DataFrame]:
    """Texts on which the attention starts: a share by a hash of (doc_id, text), of equal rows one, which grows with the ``rows`` of ``training``."""
    p = min(max(TRAIN_SHARE, LEAST_TEXTS / max(rows, 1)), 1.0)
    keyed = training.where("text is not null").select(F.col("text").cast("binary").alias("_qm_b"), *row_keys())
    u = F.pmod(F.xxhash64(F.lit("share"), *KEYS), F.lit(1 << 30)) / float(1 << 30)
    parts = max(1, round(rows * p / TASK_TEXTS))
    return (materialize(keyed.where(u < p).dropDuplicates(KEYS).repartition(parts, *KEYS).sortWithinPartitions(*KEYS), "attention"),)


def train_attention(texts: DataFrame, ids: DataFrame, class_of: np.ndarray, pairs: np.ndarray, path: str = TOKENIZER) -> Network:
    """Epochs over ``texts`` to start with, then one pass over ``coded`` ids of all; after each, weights and moments of the tasks are averaged by windows."""
    training = new_training(pairs)
    if not pairs.any():
        return training.net
    classes = np.append(class_of, STOP)

    def one(number: int, vector: np.ndarray, batched):
        def run(batches):
            mine = new_training(np.zeros((CLASSES, CLASSES)), dtype=np.float32)
            mine.set(vector)
            rng, n = np.random.default_rng((number, TaskContext.get().partitionId())), 0
            for ids, sizes in batched(batches):
                n += mine.epoch(classes[ids], sizes, min(number, EPOCHS - 1), EPOCHS, rng)
            if n:
                v = mine.vector().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v * n), pa.array(np.full(len(v), n))], names=["cell", "x", "n"])

        return run

    def batched_texts(batches):
        coder = Coder(path)
        for b in batches:
            if b.num_rows:
                yield coder(b.column(0))

    for e in range(EPOCHS + 1):
        small_batches(texts.sparkSession)
        rows = texts.select("_qm_b") if e < EPOCHS else ids.select("ids")
        rows = rows.mapInArrow(one(e, training.vector(), batched_texts if e < EPOCHS else _coded_batches), "cell int, x double, n long")
        rows = rows.groupBy("cell").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        if rows.num_rows:
            vector = np.empty(rows.num_rows)
            vector[rows["cell"].to_numpy()] = rows["x"].to_numpy()
            training.set(vector)
    return training.net


def word_share(part: DataFrame, tail: DataFrame, n: int, types: int) -> float:
    """The likeliest share of the word counts on all texts that were learned from, of ``networked`` and ``counted_tail``: each text's words are scored by the counts of the others."""
    floor, ten = float(np.log(n + types + 1)), float(np.log(10))
    gap = F.col("net") * ten + floor - F.log(F.greatest(F.col("c") - F.col("own"), F.lit(0)) + 1)
    most = F.lit(float(MOST_GAP))
    rare = tail.where("learns").select(F.round(F.least(F.greatest(gap, -most), most) / GAP_BIN).cast("int").alias("bins"), F.lit(1).cast("long").alias("k"))
    every = part.select(F.explode(F.arrays_zip("bins", "k")).alias("b")).select("b.*").unionByName(rare)
    rows = every.groupBy("bins").agg(F.sum("k").alias("k")).toArrow()
    share = 0.5
    if rows.num_rows:
        gaps, weight = rows["bins"].to_numpy() * GAP_BIN, rows["k"].to_numpy()
        for _ in range(30):
            share = float(np.clip(np.average(share / (share + (1 - share) * np.exp(gaps)), weights=weight), 1e-3, 1 - 1e-3))
    return share


def trained(training: DataFrame, counts: DataFrame, rows: int, path: str = TOKENIZER, head: Head | None = None) -> Model:
    """A model whose mixture is not yet set, of the ``rows`` of ``training`` and their ``counts``."""
    count = subword_counts(counts, path)
    ids = materialize(coded(training, path, head), "coded")
    class_of, emit = subword_classes(count, neighbours(ids, own_classes(count), path), begins(path))
    (start,) = shares(training, rows)
    net = train_attention(start, ids, class_of, class_pairs(ids, class_of, path), path)
    discard(ids)
    return Model(net, class_of, emit, 0.5, path)


def fit(training: DataFrame, counts: DataFrame, n: int, types: int, rows: int, path: str = TOKENIZER, head: dict[bytes, int] | None = None) -> Model:
    """Learn from the ``rows`` of ``training``, whose ``counts`` are of ``n`` words of so many ``types``."""
    held = Head.of(head_counts(counts) if head is None else head, path)
    model = trained(training, counts, rows, path, held)
    part = networked(training, F.col("text").isNotNull(), model, held, n, types)
    model.share = word_share(part, counted_tail(part, counts), n, types)
    return model


def scored(docs: DataFrame, k: int = 7, r: int = 2, head_words: int = HEAD_WORDS, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows whose crc32(doc_id) mod k is not r.

    A null text is empty: its end is its only token. The network passes once
    over all rows; the mixture is set on what it stored, and then made of it.
    """
    docs = docs.select("doc_id", "text")
    training = docs.where(learned_from(k, r))
    counts = materialize(word_counts(training), "counts")
    ends = F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    n, types, rows = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(ends, F.lit(0))).first()
    head = Head.of(head_counts(counts, head_words), path)
    model = trained(training, counts, rows, path, head)
    part = networked(docs, learned_from(k, r) & F.col("text").isNotNull(), model, head, n, types)
    tail = counted_tail(part, counts)
    model.share = word_share(part, tail, n, types)
    floor = float(np.log10(n + types + 1))
    log = F.log10(F.coalesce("c", F.lit(0)) + 1)
    tail = tail.groupBy("row").agg(F.count("c").alias("more"), F.sum(log).alias("log"), F.sum(mixed_column(model.share, F.col("net"), log - floor)).alias("mixed"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    part = part.select("doc_id", "gaps", "row", "n_tokens", "head_known", "head_log").mapInArrow(_mixed(model.share), f"doc_id {kind}, row long, n_tokens long, head_known long, head_log double, added double")
    out = part.join(tail, "row", "left")
    base = F.col("head_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)
    score = F.col("head_log") - F.col("head_known") * F.lit(floor) + F.col("added") + F.coalesce("mixed", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("head_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op4_lm(spark, sf_dir: str) -> DataFrame:
    s = scored(table(spark, sf_dir, "documents"))
    return s.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
