"""Benchmark decontamination by spaced-seed hashing.

Fixed masks keep six of nine token positions. Hashes of the kept tokens at
every position of every document meet those of the benchmark in a join; a hit
fixes an item and an alignment, along which all tokens are compared. Before the
join a table of bits, one for each of the benchmark's hashes, passes over nearly
all others, so that what is joined, or shuffled where the benchmark is too large
to broadcast, is little more than the hits. A document
is contaminated if some window of 13 aligned tokens (the whole item where it is
shorter) agrees in four fifths or more. The masks find every such window with
up to two substitutions; items shorter than a window have further masks, by
their length, that find a fifth of their tokens substituted at any places.

Tokens are runs of letters, digits and combining marks in lower case; of scripts
written without spaces each letter is one. Items of fewer than five tokens are
sought word for word, so a benchmark of single words finds them in any text:
``least_tokens`` leaves such items out where that is not wanted. Null texts, null
items and those without a token match nothing. Long texts are
read whole; of items of equal tokens the smallest item_id is reported; rows
equal in doc_id and text are reported once and dropped together; empty tables
match nothing; other columns stay as they are.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEYS, bounded_broadcast, drop_rows, materialize, row_keys, table

#: Kept positions of each mask.
MASKS = ((0, 1, 2, 5, 7, 8), (0, 1, 3, 4, 5, 8), (0, 4, 5, 6, 7, 8))
SPAN = 9
WINDOW = 13
SHARE = 0.8
#: Tokens that a mask of a shorter item keeps where one may be substituted, so that a hit is rare enough to be verified.
LEAST_KEPT = 4
#: A mask's first places, tested before all of it is.
FIRST = 3
#: Items shorter than this are not sought.
LEAST_TOKENS = 1
BROADCAST_SEEDS = 2_000_000
#: Binary logarithms of the least and most bits of the table of the benchmark's hashes; BITS_A_SEED for each between.
LEAST_BITS, MOST_BITS, BITS_A_SEED = 12, 26, 16
#: Code points of scripts written without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"


def tokens(text: str) -> Column:
    """Lower-case runs of letters, digits and marks; an unspaced letter with its marks is one by itself."""
    lower = F.lower(text)
    apart = F.when(lower.rlike(f"[{UNSPACED}]"), F.regexp_replace(lower, f"([{UNSPACED}]\\p{{M}}*)", " $1 ")).otherwise(lower)
    return F.regexp_extract_all(apart, F.lit(r"([\p{L}\p{N}][\p{L}\p{N}\p{M}]*)"), F.lit(1))


def _hashed(text: str) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _beginnings(masks: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The distinct first places of the masks: ``FIRST`` of each, or all that it has."""
    return list(dict.fromkeys(mask[:FIRST] for mask in masks))


def _row(number: int, places: tuple[int, ...], width: int, *more: Column) -> Column:
    """A struct (m, o0, o1, ...) of numbered places, null beyond the last."""
    row = [F.lit(o) for o in places] + [F.lit(None).cast("int")] * (width - len(places))
    return F.struct(F.lit(number).alias("m"), *[o.alias(f"o{i}") for i, o in enumerate(row)], *more)


def _begun(masks: list[tuple[int, ...]]) -> Column:
    """The masks as data, by their beginnings: an array of (m, o0, ..., masks array of (m, o0, ...)).

    One expression hashes any number of them. Beginnings are numbered below zero.
    """
    width = max(map(len, masks))
    of = lambda first: F.array(*[_row(m, mask, width) for m, mask in enumerate(masks) if mask[:FIRST] == first])
    return F.array(*[_row(-1 - g, first, FIRST, of(first).alias("masks")) for g, first in enumerate(_beginnings(masks))])


def _seed(row: str, width: int, hashes: str, pos: str) -> Column:
    """Hash of what stands at the places of ``row``, counted from ``pos``; places beyond the end count as null."""
    return F.xxhash64(f"{row}.m", *[F.get(hashes, F.col(pos) + F.col(f"{row}.o{i}")) for i in range(width)])


def bit_table(seeds: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row (_qm_bits array<long>) with a bit set for each seed, found by its highest bits, and the logarithm of its longs."""
    logs = min(max((n * BITS_A_SEED).bit_length(), LEAST_BITS), MOST_BITS) - 6
    some = seeds.groupBy(F.shiftrightunsigned("seed", 64 - logs).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("x"))
    every = seeds.sparkSession.range(1 << logs).join(some, "id", "left").select(F.struct("id", F.coalesce("x", F.lit(0).cast("long")).alias("x")).alias("s"))
    return every.agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("_qm_bits")), logs


def _maybe(seed: Column, bits: Column, logs: int) -> Column:
    """Whether the seed's bit is set."""
    word = F.get(bits, F.shiftrightunsigned(seed, 64 - logs).cast("int"))
    return F.getbit(word, seed.bitwiseAND(F.lit(63)).cast("int")) == 1


def probes(hashed: DataFrame, seeds: DataFrame, n: int, masks: list[tuple[int, ...]]) -> DataFrame:
    """(doc_id, _qm_k1, _qm_k2, pos, seed) of every position and mask of the documents whose bit is set.

    ``seeds`` holds (seed, begins). Masks of one beginning are hashed only where
    the bit of what it keeps is set, so many masks cost little more than a few.
    Positions and masks are generated, hashed and tested within one stage of
    generated code, whose size does not depend on the masks; only what passes
    leaves it. The bits (8 MB at most) are a value of the plan, not of its rows.
    """
    both = seeds.select("seed").unionByName(seeds.select(F.col("begins").alias("seed")))
    bits, logs = bit_table(both, 2 * n)
    bits = materialize(bits, "bits").scalar()
    cols = ["doc_id", *KEYS, "_qm_h"]
    # Outer, since otherwise the planner tests the array's size first by making it twice.
    at = hashed.select(*cols, F.posexplode_outer("_qm_h").alias("pos", "_qm_own")).where("pos is not null")
    at = at.select(*cols, "pos", F.explode_outer(_begun(masks)).alias("_qm_first"))
    at = at.where(_maybe(_seed("_qm_first", FIRST, "_qm_h", "pos"), bits, logs))
    every = at.select(*cols, "pos", F.explode_outer("_qm_first.masks").alias("_qm_mask"))
    every = every.select("doc_id", *KEYS, "pos", _seed("_qm_mask", max(map(len, masks)), "_qm_h", "pos").alias("seed"))
    return every.where(_maybe(F.col("seed"), bits, logs))


def short_masks(n: int) -> list[tuple[tuple[int, ...], int]]:
    """(mask, position) for an item of ``n`` tokens, below WINDOW: some of them avoids any floor(n / 5) places.

    One substitution: the places are dealt to the fewest groups, three at least,
    that leave four tokens when one group is ignored, a mask for each group.
    Otherwise MASKS where they fit, and for each choice of places that they
    don't avoid a mask of all others. A mask starts with its first kept token,
    so places beyond a document's ends count as any others.
    """
    lost = n // 5
    if lost == 1 and n < SPAN:
        groups = next(g for g in range(3, n + 1) if n - math.ceil(n / g) >= LEAST_KEPT)
        kept = [[i for i in range(n) if i % groups != g] for g in range(groups)]
        return [(tuple(i - k[0] for i in k), k[0]) for k in kept]
    out = [(mask, q) for q in range(n - SPAN + 1) for mask in MASKS]
    for bad in combinations(range(n), lost):
        if not any(all(q + m not in bad for m in mask) for mask, q in out):
            kept = [i for i in range(n) if i not in bad]
            out.append((tuple(i - kept[0] for i in kept), kept[0]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """(doc_id, _qm_k1, _qm_k2, item_id, n_matched, item_tokens, window_matched, window).

    One row per contaminated document and matched item, from the item's best
    alignment. Items of equal tokens are one, of the smallest item_id.
    """
    items = benchmark.select(F.col("item_id"), _hashed("text").alias("_qm_bh")).where(F.size("_qm_bh") >= max(least_tokens, 1))
    items = materialize(items.groupBy("_qm_bh").agg(F.min("item_id").alias("item_id")).select("item_id", "_qm_bh", F.xxhash64("_qm_bh").alias("_qm_item")), "items")
    size = F.size("_qm_bh")
    short = {r[0]: short_masks(r[0]) for r in items.where(size < WINDOW).select(size).distinct().collect()}
    masks = list(dict.fromkeys([*MASKS, *(mask for n in sorted(short) for mask, _ in short[n])]))
    wanted = F.when(size >= WINDOW, (F.col("_qm_mask.m") < len(MASKS)) & (F.col("q") + SPAN - 1 < size))
    for n, some in short.items():
        wanted = wanted.when(size == n, (F.col("q") * len(masks) + F.col("_qm_mask.m")).isin([q * len(masks) + masks.index(mask) for mask, q in some]))
    at = items.select("_qm_item", "_qm_bh", F.posexplode("_qm_bh").alias("q", "_qm_own"))
    at = at.select("_qm_item", "_qm_bh", "q", F.explode(_begun(masks)).alias("_qm_first"))
    at = at.select("*", F.explode("_qm_first.masks").alias("_qm_mask")).where(wanted)
    hashes = _seed("_qm_mask", max(map(len, masks)), "_qm_bh", "q").alias("seed"), _seed("_qm_first", FIRST, "_qm_bh", "q").alias("begins")
    seeds = at.select("_qm_item", *hashes, "q")
    seeds = materialize(seeds, "seeds")

    n_seeds = seeds.count()
    hashed = docs.select("doc_id", *row_keys(), _hashed("text").alias("_qm_h"))
    hits = probes(hashed, seeds, n_seeds, masks).join(bounded_broadcast(seeds.drop("begins"), n_seeds, BROADCAST_SEEDS), "seed")
    aligned = hits.select("doc_id", *KEYS, "_qm_item", (F.col("pos") - F.col("q")).alias("diagonal")).distinct()
    aligned = materialize(aligned, "aligned").join(items, "_qm_item")
    found = materialize(aligned.drop("doc_id"), "candidates")
    n = found.count()
    text = docs.select("doc_id", "text", *row_keys())
    some = found.select(*KEYS).distinct()
    text = text.join(bounded_broadcast(some, n), KEYS, "left_semi").select("doc_id", *KEYS, _hashed("text").alias("_qm_h"))
    # Equal rows have equal keys and tokens: one of each is enough to verify.
    both = found.join(text.dropDuplicates(KEYS), KEYS)
    same = F.transform("_qm_bh", lambda x, q: F.coalesce((F.get("_qm_h", q + F.col("diagonal")) == x).cast("int"), F.lit(0)))
    both = both.select("doc_id", *KEYS, "item_id", F.size("_qm_bh").alias("item_tokens"), same.alias("same"))
    both = both.withColumn("window", F.least(F.lit(WINDOW), "item_tokens"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("item_tokens") - F.col("window") + 1), lambda s: total(F.slice("same", s, F.col("window")))))
    both = both.select("doc_id", *KEYS, "item_id", total(F.col("same")).alias("n_matched"), "item_tokens", best.alias("window_matched"), "window")
    both = both.where(F.col("window_matched") >= F.ceil(F.col("window") * SHARE))
    row = F.struct("window_matched", "n_matched", "item_tokens", "window")
    best_row = both.groupBy("doc_id", *KEYS, "item_id").agg(F.max(row).alias("r"))
    return best_row.select("doc_id", *KEYS, "item_id", "r.n_matched", "r.item_tokens", "r.window_matched", "r.window")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents; columns unchanged."""
    return drop_rows(docs, contaminated(docs, benchmark))


assert all(max(m) < SPAN for m in MASKS) and math.ceil(WINDOW * SHARE) == 11


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item; documents without a match do not appear."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "item_tokens", "window_matched", "window")
