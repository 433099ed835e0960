"""Exact ranks and cuts without one task that sorts everything.

``numbered`` and ``extreme_groups`` count rows per (sort level, bucket of input
order); sums over those few counts give what stands before a bucket, and only
within a bucket are rows numbered. Levels are score values, of which a test has
at most a few hundred. ``placed`` takes any key: rows of a sample cut the order
into ranges, counts of ranges give what stands before each, and only within a
range are rows numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Consecutive input positions in one bucket: what one window partition sorts.
BUCKET = 4096
#: Rows of the sample whose quantiles cut an order into ranges.
SAMPLE = 4096

#: A sort key: a column's name and whether it falls. Nulls come last when falling, first when rising.
SortKey = tuple[str, bool]


def numbered(df: DataFrame, level: str | None = None, ord_col: str = "sheet_ord", out: str = "rk", descending: bool = True) -> DataFrame:
    """``df`` with its 1-based rank by ``level`` (nulls last when descending, first when ascending), ties by ``ord_col``.

    Without a level the rank is that of the input order. ``ord_col`` is unique and not null.
    """
    keyed = df.withColumn("_qm_bucket", F.floor(F.col(ord_col) / BUCKET))
    keyed = keyed.withColumn("_qm_level", F.col(level) if level else F.lit(0))
    counts = keyed.groupBy("_qm_level", "_qm_bucket").agg(F.count("*").alias("_qm_n"))
    level_order = F.col("_qm_level").desc_nulls_last() if descending else F.col("_qm_level").asc_nulls_first()
    levels = counts.groupBy("_qm_level").agg(F.sum("_qm_n").alias("_qm_all"))
    before = Window.orderBy(level_order).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("_qm_level", F.coalesce(F.sum("_qm_all").over(before), F.lit(0)).alias("_qm_above"))
    ahead = Window.partitionBy("_qm_level").orderBy("_qm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_qm_ahead", F.coalesce(F.sum("_qm_n").over(ahead), F.lit(0))).drop("_qm_n")
    offsets = counts.alias("c").join(levels.alias("l"), F.col("c._qm_level").eqNullSafe(F.col("l._qm_level")))
    offsets = offsets.select(F.col("c._qm_level").alias("_qm_l"), F.col("c._qm_bucket").alias("_qm_b"), (F.col("_qm_above") + F.col("_qm_ahead")).alias("_qm_before"))
    within = Window.partitionBy("_qm_level", "_qm_bucket").orderBy(ord_col)
    joined = keyed.join(offsets, F.col("_qm_level").eqNullSafe(F.col("_qm_l")) & (F.col("_qm_bucket") == F.col("_qm_b")))
    ranked = joined.withColumn(out, (F.col("_qm_before") + F.row_number().over(within)).cast("long"))
    return ranked.drop("_qm_level", "_qm_bucket", "_qm_l", "_qm_b", "_qm_before")


def extreme_groups(df: DataFrame, level: str = "raw_score", ord_col: str = "sheet_ord", share: float = 0.27) -> DataFrame:
    """One row (n, group_size, upper_at, upper_cut, lower_at, lower_cut) that tells who is in the extreme groups.

    In the order of falling ``level``, ties by input order, a row is among the
    first ``group_size`` if its level is above upper_at, or equal and its
    position at most upper_cut; the last likewise. No row for an empty table.

    Rows are counted once by level and bucket. From these counts come the level
    at each border, how many of its ties belong to the group, and the bucket
    where that number is reached; only the rows of two buckets are sorted.
    """
    rows = df.select(F.col(level).alias("at"), F.col(ord_col).alias("ord"), F.floor(F.col(ord_col) / BUCKET).alias("bucket"))
    counts = rows.groupBy("at", "bucket").agg(F.count("*").alias("c"))

    levels = counts.groupBy("at").agg(F.sum("c").alias("c"))
    falling = Window.orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("n", F.sum("c").over(Window.partitionBy())).withColumn("upto", F.sum("c").over(falling))
    levels = levels.withColumn("g", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share) + 0.5)).cast("long"))
    above, below = F.col("upto") - F.col("c"), F.col("n") - F.col("upto")
    side = lambda name, before: F.when((before < F.col("g")) & (before + F.col("c") >= F.col("g")), F.struct(F.lit(name).alias("side"), (F.col("g") - before).alias("m")))
    sides = levels.select("n", "g", "at", F.inline(F.array_compact(F.array(side("upper", above), side("lower", below)))))

    cuts = tie_cuts(rows, sides.select("side", "at", "m"), counts)
    pick = lambda name, c: F.max(F.when(F.col("side") == name, F.col(c)))
    return cuts.join(F.broadcast(sides.select("side", "n", "g")), "side").groupBy("n", F.col("g").alias("group_size")).agg(
        pick("upper", "at").alias("upper_at"), pick("upper", "cut").alias("upper_cut"), pick("lower", "at").alias("lower_at"), pick("lower", "cut").alias("lower_cut")
    )


def tie_cuts(rows: DataFrame, sides: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(side, at, cut): the position up to which the ``m`` earliest (side upper) or latest (lower) rows of a level reach.

    ``rows`` are (at, ord), ``sides`` are two rows (side, at, m) at most. The
    rows of the two levels are counted by buckets of positions; only those of
    the two buckets where m is reached are sorted.
    """
    rows = rows.select("at", "ord", F.floor(F.col("ord") / BUCKET).alias("bucket"))
    if counts is None:
        counts = rows.join(F.broadcast(sides.select("at").distinct()), "at").groupBy("at", "bucket").agg(F.count("*").alias("c"))
    # The upper side takes its ties from the earliest position, the lower from the latest.
    sign = F.when(F.col("side") == "upper", 1).otherwise(-1)
    order = Window.partitionBy("side").orderBy(sign * F.col("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    ties = counts.join(F.broadcast(sides), "at").withColumn("upto", F.sum("c").over(order))
    reached = ties.where((F.col("upto") >= F.col("m")) & (F.col("upto") - F.col("c") < F.col("m")))
    reached = reached.select("at", "bucket", "side", (F.col("m") - F.col("upto") + F.col("c")).alias("nth"))
    inside = rows.join(F.broadcast(reached), ["at", "bucket"])
    nth = inside.withColumn("i", F.row_number().over(Window.partitionBy("side").orderBy(sign * F.col("ord")))).where("i = nth")
    return nth.select("side", "at", F.col("ord").alias("cut"))


def in_upper(level: str = "raw_score", ord_col: str = "sheet_ord") -> Column:
    return (F.col(level) > F.col("upper_at")) | ((F.col(level) == F.col("upper_at")) & (F.col(ord_col) <= F.col("upper_cut")))


def in_lower(level: str = "raw_score", ord_col: str = "sheet_ord") -> Column:
    return (F.col(level) < F.col("lower_at")) | ((F.col(level) == F.col("lower_at")) & (F.col(ord_col) >= F.col("lower_cut")))


def _order(keys: list[SortKey]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_first() for c, falls in keys]


def _reached(cut: Column, keys: list[SortKey]) -> Column:
    """Whether the row stands at or behind the struct ``cut``."""
    out = F.lit(True)
    for c, falls in reversed(keys):
        a, b = cut[c], F.col(c)
        ahead = F.coalesce(a > b if falls else a < b, (a.isNotNull() & b.isNull()) if falls else (a.isNull() & b.isNotNull()))
        out = ahead | (a.eqNullSafe(b) & out)
    return out


def placed(df: DataFrame, keys: list[SortKey], out: str = "place", ranges: int | None = None) -> DataFrame:
    """``df`` with its exact 1-based place in the order of ``keys``, whatever their types and however many values they have.

    The last key should tell rows apart: rows equal in all keys share a range
    and are numbered in any order there, and a value that very many rows hold
    is split at the keys behind it. Cuts are quantiles of ``SAMPLE`` random
    rows, the only ones to reach the driver, so a range holds about its share;
    a row finds its range in two short searches, over every so many cuts and
    between two of these. One shuffle by range. ``df`` is read three times
    (sample, counts, result): store it first if it is costly. An empty table
    gives an empty table.
    """
    spark, names = df.sparkSession, [c for c, _ in keys]
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = T.StructType([df.schema[c] for c in names])
    sample = df.select(*names).orderBy(F.rand(0)).limit(SAMPLE).orderBy(*_order(keys)).collect()
    cuts = [tuple(r) for i, r in enumerate(sample) if i % max(1, len(sample) // ranges) == 0]
    one = spark.createDataFrame([(cuts,)], T.StructType([T.StructField("_qm_cuts", T.ArrayType(kinds))]))
    every = max(1, round(ranges**0.5))
    one = one.withColumn("_qm_coarse", F.filter("_qm_cuts", lambda _, i: i % every == 0))
    upto = lambda cuts: F.size(F.filter(cuts, lambda x: _reached(x, keys)))
    ranged = df.crossJoin(F.broadcast(one)).withColumn("_qm_part", F.greatest(F.lit(0), upto("_qm_coarse") - 1) * every)
    ranged = ranged.withColumn("_qm_range", F.col("_qm_part") + upto(F.slice("_qm_cuts", F.col("_qm_part") + 1, F.lit(every)))).drop("_qm_cuts", "_qm_coarse", "_qm_part")
    counts = ranged.groupBy("_qm_range").agg(F.count("*").alias("_qm_n"))
    before = Window.orderBy("_qm_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_qm_range", F.coalesce(F.sum("_qm_n").over(before), F.lit(0)).alias("_qm_before"))
    within = Window.partitionBy("_qm_range").orderBy(*_order(keys))
    placed_rows = ranged.join(F.broadcast(offsets), "_qm_range")
    return placed_rows.withColumn(out, (F.col("_qm_before") + F.row_number().over(within)).cast("long")).select(*df.columns, out)
