"""Exact duplicates: two Bloom filters find what may be repeated, and only that is shuffled.

Pass one reads the texts once and stores a narrow row for each: its id, its
length and the SHA-256 of what counts as its text. Each task turns its hashes
into bit positions and sends these, a few bytes a row, to the tasks that own
the segments of the filters; there the first filter holds the positions met
and the second those met again. Only the second, whose size is bounded, goes
to every task. Pass two tests the narrow rows: one whose positions are not all
in the second filter is surely alone and passes straight through; the others
are shuffled and grouped by their whole SHA-256, so a false alarm of the
filter costs a shuffled row and changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialize, row_keys, table, with_keys

#: Characters that do not count when texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of a filter for each row, and positions of a row among them.
BITS_PER_ROW = 16
PROBES = 2
#: Bounds of a filter: 64 MB at most. More rows than 16 bits each allow make more false alarms, no other result.
LEAST_BITS = 1 << 20
MOST_BITS = 1 << 29
#: Bits in a segment, the share of one reducing step.
SEGMENT_BITS = 1 << 20
#: Positions that a task holds before it sends them.
HELD = 1 << 21
#: Groups of 64 bytes or so that may be broadcast; beyond it the join is salted over so many copies.
GROUPS = 250_000
SALT = 16


def normalised(text: str | Column = "text") -> Column:
    """The text without blanks, null as empty: what must be identical."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A stored narrow row (doc_id, _qm_k1, _qm_k2, row, points, sha) for each document; row numbers are unique, in no order."""
    sha = F.unhex(F.sha2(normalised("text").cast("binary"), 256))
    rows = docs.select("doc_id", *row_keys(), F.monotonically_increasing_id().alias("row"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"), sha.alias("sha"))
    return materialize(rows, "fingerprints")


def filter_bits(rows: int, bits_per_row: int = BITS_PER_ROW, most: int = MOST_BITS) -> int:
    """Bits of a filter for ``rows`` rows: a power of two within the bounds."""
    wanted = max(LEAST_BITS, rows * bits_per_row)
    return min(1 << (wanted - 1).bit_length(), most)


def _positions(col: pa.Array, bits: int) -> np.ndarray:
    """(rows, PROBES) bit positions of 32-byte hashes."""
    words = np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, 4)
    return words[:, :PROBES] & np.uint64(bits - 1)


def segment_bits(bits: int) -> int:
    return min(bits, SEGMENT_BITS)


def _partial(bits: int):
    """Positions of a task's rows by segment: those met, and those met more than once."""
    each = segment_bits(bits)

    def flush(held):
        at, n = np.unique(np.concatenate(held), return_counts=True)
        segment = (at // each).astype(np.int32)
        inside = (at % each).astype(np.uint32)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        met, again = [], []
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            met.append(inside[a:b].tobytes())
            again.append(inside[a:b][n[a:b] > 1].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(segment[starts], pa.int32()), pa.array(met, pa.binary()), pa.array(again, pa.binary())], names=["segment", "met", "again"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(_positions(b.column(0), bits).ravel())
                size += held[-1].size
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _merged(each: int):
    """The second filter's segments with at least one bit: a byte for each bit of both filters' segments that the task owns."""

    def run(batches):
        first: dict[int, np.ndarray] = {}
        second: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, met, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                once = first.setdefault(segment, np.zeros(each, bool))
                twice = second.setdefault(segment, np.zeros(each, bool))
                at = np.frombuffer(met, np.uint32)
                twice[at[once[at]]] = True
                twice[np.frombuffer(again, np.uint32)] = True
                once[at] = True
        kept = {s: np.packbits(x, bitorder="little").tobytes() for s, x in second.items() if x.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array(list(kept.values()), pa.binary())], names=["segment", "bits"])

    return run


def repeated_filter(rows: DataFrame, bits: int) -> np.ndarray:
    """Bytes of the second filter: the positions that at least two rows of ``rows`` (sha) share."""
    segments = bits // segment_bits(bits)
    partial = rows.select("sha").mapInArrow(_partial(bits), "segment int, met binary, again binary")
    # A task owns about 8 segments and holds two bytes for each of their bits, 16 MB.
    merged = partial.repartition(max(1, segments // 8), "segment").mapInArrow(_merged(segment_bits(bits)), "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    size = segment_bits(bits) // 8
    for segment, packed in merged.toLocalIterator():
        out[segment * size : (segment + 1) * size] = np.frombuffer(packed, np.uint8)
    return out


def _tested(known, bits: int):
    """``maybe``: whether all positions of the row's hash are in the filter that the broadcast ``known`` holds."""

    def run(batches):
        table_ = known.value
        for b in batches:
            if not b.num_rows:
                continue
            at = _positions(b.column(b.schema.get_field_index("sha")), bits)
            hit = (table_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*b.schema.names, "maybe"])

    return run


def tested(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Stored ``rows`` with maybe: false only for rows whose sha no other row has."""
    spark = rows.sparkSession
    bits = bits or filter_bits(rows.count())
    known = spark.sparkContext.broadcast(repeated_filter(rows, bits))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, maybe boolean"
    out = materialize(rows.mapInArrow(_tested(known, bits), schema), "tested")
    known.destroy()
    return out


def duplicates(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256, _qm_k1, _qm_k2, row) for each row of ``docs`` (doc_id, text).

    Texts are equal when they are identical without blanks; a null text is an
    empty one. Of equal texts the row with the most code points stays, then
    that of the smallest doc_id (null last); of rows equal in both, one. An
    empty table gives an empty table; other columns of ``docs`` do not matter.
    A group's rows are counted in partial sums, and meet their group in a join
    whose keys are salted where it is not broadcast, so a text on a third of
    all rows stays spread.
    """
    raw = fingerprints(docs)
    rows = tested(raw, bits)
    discard(raw)
    alone = rows.where("not maybe").select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    shared = rows.where("maybe")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = shared.groupBy("sha").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("sha", F.col("best.doc_id").alias("first_id"), F.col("best.row").alias("first_row"), "n"), "groups")
    count = groups.count()
    if count <= GROUPS:
        met = shared.join(bounded_broadcast(groups, count, GROUPS), "sha", "left")
    else:
        copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = shared.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(copies, ["sha", "salt"], "left").drop("salt")
    grouped = F.col("n").isNotNull()
    met = met.select(*rows.columns, F.when(grouped, F.col("first_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (~grouped | (F.col("row") == F.col("first_row"))).alias("kept"))
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "_qm_k1", "_qm_k2", "row")


def deduplicated(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns unchanged, whatever they are called.

    Rows whose text is alone pass without a shuffle if the keys of the others
    can be broadcast. Of rows equal in doc_id and text that stay, one is taken.
    """
    found = materialize(duplicates(docs, bits).where("group_size > 1").select("_qm_k1", "_qm_k2", "kept"), "repeated")
    keyed, names = with_keys(docs)
    every = found.select("_qm_k1", "_qm_k2").distinct().toDF(*names)
    stay = found.where("kept").select("_qm_k1", "_qm_k2").distinct().toDF(*names)
    passing = keyed.join(bounded_broadcast(every, found.count()), names, "left_anti")
    chosen = keyed.join(bounded_broadcast(stay, found.count()), names, "left_semi").dropDuplicates(names)
    return passing.unionByName(chosen).drop(*names)


def op12_exact(spark, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
