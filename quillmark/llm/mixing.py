"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Sources in the order of their code points weigh 5, 2, 1, 5, ...;
   together they take as many words as there are; none takes more than 3 times
   its own, the excess going to the others by weight.
2. Blocks. Each source's documents, in hashed order, form one stream of words,
   cut into blocks. A source's quota is the number of blocks nearest its target.
3. Tree. The quotas are split among the output shards: a node draws its left
   half's quotas from its own by the multivariate hypergeometric law, the rest
   goes right, down to one shard. Draws are functions of the seed and the node.
4. Blocks are drawn in a permuted order, every block once before any is drawn
   again; a shard takes the next run of each source's draws, so shards are
   disjoint. Within a shard, the order of a hash gives the places: it is
   shuffled locally.

A null or blank text has no words and nothing is taken of it; a null source is a
source, the last; rows equal in doc_id and text are separate documents, in any
order; a table without words has target 0 throughout and an empty table gives an
empty one; other columns are not read, but for those asked for.

Only DataFrame and SQL functions are used. Positions come from sums over
buckets of about ``BUCKET_DOCS`` documents, so no source is in one task. The
tree's nodes are dealt anew every ``LEVELS`` levels. A draw finds its shard in a
join on (source, the shard where it would be if the source were spread evenly),
to which each shard's run is listed under the few even shards that it overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEYS, bounded_broadcast, materialize, row_keys, table

#: Weights by rank of the source, and the most a source is repeated.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a block; a small source has smaller ones, so that it has about BLOCKS of them.
BLOCK_WORDS, BLOCKS = 64, 1000
SHARD_WORDS = 4_000_000
BUCKET_DOCS = 4096
#: Rows of sources that may be broadcast; beyond it they are copied SALT times and joined.
BROADCAST_SOURCES, SALT = 500_000, 64
#: Runs (sources times shards) that may be broadcast.
BROADCAST_RUNS = 500_000
#: Levels of the tree that are unfolded where their root is.
LEVELS = 8
SEED = 20_240_229
#: Primes, one of which does not divide the number of blocks.
PRIMES = (15_485_863, 32_452_843, 49_979_687, 67_867_967, 86_028_121)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(ix, source, source_size, n_docs, target), a row per source.

    The windows without a partition hold one row per source, not per document.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    src = src.withColumn("ix", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("ix") % len(WEIGHTS) + 1).cast("double")
    src = src.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(MOST))
    by = Window.orderBy(F.col("cap") / F.col("w"), "ix")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    src = src.withColumn("total", F.sum("source_size").over(everything))
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    src = src.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    target = F.least("cap", F.col("w") * F.coalesce("level", F.lit(0.0)))
    return src.select("ix", "source", "source_size", "n_docs", target.alias("target"))


def quotas(src: DataFrame) -> DataFrame:
    """``targets`` with block (words), n_blocks, quota (blocks drawn) and the permutation's step and shift."""
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / BLOCKS))).cast("long")
    out = src.withColumn("block", block).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    out = out.withColumn("quota", F.least(F.col("n_blocks") * MOST, F.round(F.col("target") / F.col("block")).cast("long")))
    step = F.coalesce(*[F.when(F.col("n_blocks") % p != 0, F.lit(p)) for p in PRIMES]).cast("long")
    return out.withColumn("step", F.coalesce(step, F.lit(1))).withColumn("shift", F.when(F.col("n_blocks") > 0, F.pmod(F.xxhash64(F.lit(SEED), "ix"), "n_blocks")))


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ln_factorial(n: str) -> str:
    """Stirling's series 8 above n, minus the logarithms in between."""
    product = " * ".join(f"(f + {i}D)" for i in range(1, 9))
    return _let("f", n, f"(f + 8.5D) * ln(f + 8D) - (f + 8D) + 0.9189385332046727D + 1 / (12D * (f + 8D)) - 1 / (360D * pow(f + 8D, 3)) + 1 / (1260D * pow(f + 8D, 5)) - ln({product})")


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n}) - ({k})')})"


def hypergeometric(population: str, good: str, draws: str, u: str) -> str:
    """SQL of the number of good ones among ``draws`` from ``population``, at the uniform number ``u``.

    Probabilities are added from the mode outwards until they exceed u.
    """
    start = f"named_struct('r', {population}, 'k', {good}, 'n', {draws}, 'u', {u})"
    mode = "least(least(p.k, p.n), greatest(greatest(0D, p.n + p.k - p.r), floor((p.n + 1) * (p.k + 1) / (p.r + 2)) * 1D))"
    at_mode = f"exp({_ln_choose('p.k', 'q.m')} + {_ln_choose('p.r - p.k', 'p.n - q.m')} - {_ln_choose('p.r', 'p.n')})"
    spread = "12 * sqrt(p.n * (p.k / p.r) * (1 - p.k / p.r)) + 12"
    up = "if(a.hi >= least(p.k, p.n), 0D, a.ph * (p.k - a.hi) * (p.n - a.hi) / ((a.hi + 1) * (p.r - p.k - p.n + a.hi + 1)))"
    down = "if(a.lo <= greatest(0D, p.n + p.k - p.r), 0D, a.pl * a.lo * (p.r - p.k - p.n + a.lo) / ((p.k - a.lo + 1) * (p.n - a.lo + 1)))"
    moved = _let(
        "s", f"named_struct('ph', {up}, 'pl', {down})",
        "named_struct('x', case when a.u < s.ph then a.hi + 1 when a.u < s.ph + s.pl then a.lo - 1 else -1D end, 'u', a.u - s.ph - s.pl, 'hi', a.hi + 1, 'lo', a.lo - 1, 'ph', s.ph, 'pl', s.pl)",
    )
    first = "named_struct('x', if(p.u < q2.pm, q.m, -1D), 'u', p.u - q2.pm, 'hi', q.m, 'lo', q.m, 'ph', q2.pm, 'pl', q2.pm)"
    walk = f"aggregate(sequence(1, cast({spread} as int)), {first}, (a, i) -> if(a.x >= 0, a, {moved}), a -> if(a.x >= 0, a.x, q.m))"
    drawn = _let("p", start, _let("q", f"named_struct('m', {mode})", _let("q2", f"named_struct('pm', {at_mode})", walk)))
    return f"if({good} <= 0D or {draws} <= 0D, 0D, if({good} >= {population}, {draws}, {drawn}))"


def _split() -> str:
    """SQL of the left child's quotas: the sources' numbers among ``take`` draws, one source after another."""
    uniform = f"shiftrightunsigned(xxhash64({SEED}, lo, hi, size(b.out)), 11) / 9007199254740992D"
    draw = hypergeometric("b.r", "cast(k as double)", "b.n", uniform)
    step = _let("d", draw, "named_struct('r', b.r - k, 'n', b.n - d, 'out', concat(b.out, array(cast(d as bigint))))")
    zero = "named_struct('r', cast(aggregate(quotas, 0L, (x, y) -> x + y) as double), 'n', cast(take as double), 'out', cast(array() as array<bigint>))"
    return f"aggregate(quotas, {zero}, (b, k) -> {step}, b -> b.out)"


def split_tree(root: DataFrame, shards: int) -> DataFrame:
    """(shard, quotas) leaves from a row (quotas array<long>).

    Each level turns a row into two, by itself; after every ``LEVELS`` levels
    the rows are dealt over tasks. Shards' sizes differ by one block at most.
    """
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda x, y: x + y)
    tree = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), total.cast("decimal(38,0)").alias("all"), "quotas")
    size = lambda a, b: f"cast(floor(`all` * {b} / {shards}) - floor(`all` * {a} / {shards}) as bigint)"
    for level in range((shards - 1).bit_length()):
        if level and level % LEVELS == 0:
            tree = materialize(tree.repartition(min(1 << level, 4096), "lo"), "tree")
        tree = tree.withColumn("mid", F.expr("lo + (hi - lo) div 2")).withColumn("take", F.expr(size("lo", "mid")))
        tree = tree.withColumn("left", F.when(F.col("mid") > F.col("lo"), F.expr(_split())))
        left = "named_struct('lo', lo, 'hi', mid, 'quotas', left)"
        right = "named_struct('lo', mid, 'hi', hi, 'quotas', if(left is null, quotas, zip_with(quotas, left, (x, y) -> x - y)))"
        tree = tree.select("all", F.explode(F.expr(f"filter(array({left}, {right}), c -> c.quotas is not null)")).alias("c"))
        tree = tree.select("all", "c.lo", "c.hi", "c.quotas")
    return tree.select(F.col("lo").alias("shard"), "quotas")


def runs(q: DataFrame, shards: int) -> DataFrame:
    """(ix, even, shard, start, end): draws start to end - 1 of a source go to ``shard``, listed under each even shard that they touch."""
    root = q.agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "quota"))), lambda x: x["quota"]).alias("quotas"))
    leaves = materialize(split_tree(root, shards), "shards")
    cell = leaves.select("shard", F.posexplode("quotas").alias("ix", "n"))
    # Sums over groups of shards first, so that no task adds up all shards of a source.
    cell = cell.withColumn("group", F.floor(F.col("shard") / BUCKET_DOCS))
    order = Window.partitionBy("ix").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cell.groupBy("ix", "group").agg(F.sum("n").alias("m")).select("ix", "group", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("ix", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0))).join(ahead, ["ix", "group"]).withColumn("start", F.col("start") + F.col("ahead"))
    cell = cell.where("n > 0").withColumn("end", F.col("start") + F.col("n")).join(F.broadcast(q.select("ix", "quota")), "ix")
    under = F.sequence(_even(F.col("start"), shards), _even(F.col("end") - 1, shards))
    return materialize(cell.select("ix", "shard", "start", "end", F.explode(under).alias("even")), "runs")


def _even(draw: Column, shards: int) -> Column:
    """The shard of a draw if its source's ``quota`` were spread evenly."""
    return F.floor(draw.cast("double") * F.lit(shards) / F.col("quota")).cast("long")


def _with_source(docs: DataFrame, src: DataFrame, sources: int) -> DataFrame:
    """Join documents to their source's row; the source may be null, and one may hold any share of the rows."""
    src = src.withColumnRenamed("source", "_qm_source")
    if sources <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(src), F.col("source").eqNullSafe(F.col("_qm_source"))).drop("_qm_source")
    salted = src.withColumn("_qm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    on = F.col("source").eqNullSafe(F.col("_qm_source")) & (F.pmod(F.col(KEYS[1]), F.lit(SALT)).cast("int") == F.col("_qm_salt"))
    return docs.join(salted, on).drop("_qm_source", "_qm_salt")


def placed(docs: DataFrame, keep: tuple[str, ...] = (), shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """Every document at its place in its source's stream of words, the sources' rows (``quotas``), and the number of shards.

    (doc_id, _qm_k1, _qm_k2, source, size, kept columns as _qm_0 and so on, the
    columns of ``quotas``, start).
    """
    named = [F.col(c).alias(f"_qm_{i}") for i, c in enumerate(keep)]
    sizes = docs.select("doc_id", *row_keys(), F.col("source").cast("string"), word_count().alias("size"), *named)
    sizes = materialize(sizes, "sized")
    src = materialize(targets(sizes), "targets")
    n, total = src.agg(F.count("*"), F.sum("source_size")).first()
    q = materialize(quotas(src), "quotas")
    rows = _with_source(sizes, q, n)
    rows = rows.withColumn("bucket", F.pmod(F.col(KEYS[0]), F.ceil(F.col("n_docs") / BUCKET_DOCS)))
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(Window.partitionBy("ix", "bucket").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = materialize(rows, "rows")
    ahead = rows.groupBy("ix", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = materialize(ahead.select("ix", "bucket", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("ahead")), "ahead")
    rows = rows.join(bounded_broadcast(ahead, ahead.count()), ["ix", "bucket"]).withColumn("start", F.col("start") + F.col("ahead")).drop("bucket", "ahead")
    return rows, q, max(1, -(-(total or 0) // shard_words))


def draws(rows: DataFrame, q: DataFrame, shards: int) -> DataFrame:
    """What the mix takes of the ``placed`` rows: (doc_id, _qm_k1, _qm_k2, ix, source, start, first_word, n_words, repeat, shard, place).

    A shard holds the words of ``SHARD_WORDS`` at most, so the window that
    shuffles it is bounded.
    """
    block = _let(
        "o", "named_struct('a', greatest(start, b * block), 'z', least(start + size, (b + 1) * block), 'd', pmod(b * step + shift, n_blocks))",
        f"transform(filter(transform(sequence(0, {MOST - 1}), e -> e * n_blocks + o.d), d -> d < quota), d -> named_struct('first_word', o.a - start, 'n_words', o.z - o.a, 'repeat', cast(d div n_blocks as int), 'draw', d))",
    )
    every = F.expr(f"flatten(transform(sequence(start div block, (start + size - 1) div block), b -> {block}))")
    one = rows.where("size > 0").select("doc_id", *KEYS, "ix", "source", "start", "quota", F.explode(every).alias("d")).select("doc_id", *KEYS, "ix", "source", "start", "quota", "d.*")
    one = one.withColumn("even", _even(F.col("draw"), shards))
    r = runs(q, shards).withColumnsRenamed({"start": "_qm_from", "end": "_qm_to"})
    one = one.join(bounded_broadcast(r, r.count(), BROADCAST_RUNS), ["ix", "even"]).where("draw >= _qm_from and draw < _qm_to")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), *KEYS, "first_word", "repeat"), *KEYS, "start", "first_word", "repeat")
    return one.select("doc_id", *KEYS, "ix", "source", "start", "first_word", "n_words", "repeat", "shard", F.row_number().over(local).alias("place"))


def mixture(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: (doc_id, source, shard, place, first_word, n_words, repeat), places counting from 1 in each shard."""
    return draws(*placed(docs, (), shard_words)).select("doc_id", "source", "shard", "place", "first_word", "n_words", "repeat")


def _with_draws(docs: DataFrame, keep: tuple[str, ...], shard_words: int) -> tuple[DataFrame, int]:
    """``placed`` rows with draws, an array of (shard, place, first_word, n_words, repeat), empty where nothing is taken; and the number of shards.

    A source and a start name a document that has words.
    """
    rows, q, shards = placed(docs, keep, shard_words)
    mine = draws(rows, q, shards).groupBy("ix", F.col("start").alias("_qm_at")).agg(F.array_sort(F.collect_list(F.struct("shard", "place", "first_word", "n_words", "repeat"))).alias("draws"))
    rows = rows.withColumn("_qm_at", F.when(F.col("size") > 0, F.col("start"))).join(mine, ["ix", "_qm_at"], "left")
    return rows.withColumn("draws", F.coalesce("draws", F.array().cast(mine.schema["draws"].dataType))), shards


def _figures() -> list[Column]:
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["n_words"])
    n_shards = F.size(F.array_distinct(F.transform("draws", lambda d: d["shard"])))
    return [F.col("doc_id"), F.col("source"), F.col("size"), F.col("source_size"), F.col("target"), words.alias("taken"), n_shards.alias("n_shards")]


def taken(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, n_shards, places_hash) of every row.

    taken is the number of words the mix takes, repeats counted; places_hash a
    hash of where they stand: (shard, place, first_word, n_words, repeat) of all draws.
    """
    return _with_draws(docs, (), shard_words)[0].select(*_figures(), F.xxhash64("draws").alias("places_hash"))


def mixed(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``taken`` with the texts: text, that of the document, and pieces, what the mix takes of it.

    pieces is a JSON array of {shard, place, text}: the pieces of all documents
    in the order of shard and place are the mixed corpus (``corpus``).
    """
    texts = docs.select("doc_id", "source", "text").withColumn("_qm_row", F.monotonically_increasing_id())
    # Rows get their numbers once; places are worked out without texts, which meet them in one shuffle, a shard's worth a task.
    texts = materialize(texts, "texts")
    rows, shards = _with_draws(texts, ("_qm_row",), shard_words)
    rows = rows.select(*_figures(), "draws", F.col("_qm_0").alias("_qm_row")).repartition(shards, "_qm_row")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    met = texts.select("_qm_row", "text").repartition(shards, "_qm_row").join(rows, "_qm_row")
    piece = lambda w: lambda d: F.struct(d["shard"].alias("shard"), d["place"].alias("place"), F.array_join(F.slice(w, d["first_word"].cast("int") + 1, d["n_words"].cast("int")), " ").alias("text"))
    # Bound as an element, the words of a text are found once, not for each piece.
    pieces = F.get(F.transform(F.array(words), lambda w: F.to_json(F.transform("draws", piece(w)))), F.lit(0))
    return met.select("doc_id", "source", "size", "source_size", "target", "taken", "n_shards", "text", pieces.alias("pieces"))


def corpus(mix: DataFrame, path: str) -> None:
    """Write what ``mixed`` gave as Parquet, a folder for each shard, rows in their local order."""
    piece = F.explode(F.from_json("pieces", "array<struct<shard:int,place:int,text:string>>"))
    rows = mix.select("doc_id", "source", piece.alias("p")).select("doc_id", "source", "p.*")
    rows.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))
