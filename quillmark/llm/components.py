"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above u points at the least of u and its neighbours."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """u and its neighbours below point at the least neighbour."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    below = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs to one row (u, v) per node above its component's least node v.

    Least nodes themselves do not appear. Each round is written to the shared
    folder; nothing but two numbers a round reaches the driver. Loops and
    repeated edges are ignored; an empty table gives an empty table.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    last = _state(e)
    for _ in range(max_rounds):
        if not last[0]:
            return e
        before, e = e, materialize(_small_star(_large_star(e).where("u <> v").distinct()).distinct(), "stars")
        discard(before)
        now = _state(e)
        if now == last:
            return e
        last = now
    raise RuntimeError("components did not settle")
