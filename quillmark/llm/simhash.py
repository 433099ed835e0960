"""SimHash near-duplicate classes by pigeonhole blocks.

A fingerprint has 64 bits. Cut into b blocks, two fingerprints that differ in
at most 4 bits agree in at least b - 4 whole blocks, so one of the C(b, 4) keys
made of b - 4 blocks is equal in both. Candidates meet in a join on the key and
are verified by their Hamming distance. b grows with the number of distinct
fingerprints, so that unrelated fingerprints rarely meet; any b gives the same
links.

Equal fingerprints are one node from the start, so copies cost one row. A key's
group is dealt over sub-blocks of about ``CHUNK`` fingerprints, every pair of
sub-blocks is compared in one numpy call, and what leaves it is a spanning
forest, never all pairs.

Null and empty texts have fingerprint zero and link like any other; texts of
any length count whole; repeated rows all come back (``classes``) or leave one
(``near_dedup``); an empty table gives an empty one; other columns are not read
by ``classes`` and stay as they are in ``near_dedup``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, materialize, row_keys, small_batches, table, texts_of, with_keys
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
CHUNK = 256
#: A fingerprint or class on more than one in HOT rows is hot.
HOT = 1024


def fingerprint(data: bytes, k: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: ASCII lower case, words split at ASCII white space, k-word shingles."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)],
        dtype=">u8",
    )
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        votes += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        fp = np.array([fingerprint(x) for x in texts_of(b, b.num_columns - 1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _qm_k1, _qm_k2, fp): one row per document, fp a signed 64-bit long; a null text counts as empty."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", *row_keys(), F.col("text").cast("binary").alias("_qm_b"))
    return keyed.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _qm_k1 long, _qm_k2 long, fp long")


def block_count(n: int, per_key: float = 4.0) -> int:
    """Fewest blocks, 6 at least, with which a key groups about ``per_key`` unrelated fingerprints at most."""
    for b in range(6, 17):
        if n <= per_key * 2 ** (64 * (b - DISTANCE) // b):
            return b
    return 16


def block_masks(b: int) -> list[int]:
    """One mask of kept bits for each choice of b - 4 of the b blocks."""
    edges = [64 * i // b for i in range(b + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(keep) for keep in combinations(blocks, b - DISTANCE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(a: np.ndarray, b: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links of a spanning forest over fingerprints of a and b at most 4 bits apart."""
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= DISTANCE
    if same:
        near = np.triu(near, 1)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        x, y = root(int(a[i])), root(int(b[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(a[i]), int(b[j])))
    return out


def _verify(batches):
    for batch in batches:
        u, v = [], []
        for same, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            a = left.values.to_numpy(zero_copy_only=False)
            for x, y in _forest(a, a if same else right.values.to_numpy(zero_copy_only=False), same):
                u.append(x)
                v.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) that connect every two of the ``n`` distinct fingerprints (column fp) within 4 bits."""
    masks = block_masks(block_count(n))
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]))
    member = distinct.select("fp", key.alias("x")).select("fp", F.xxhash64("x.t", "x.k").alias("key"))
    crowd = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = member.join(crowd, "key").withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    chunk = dealt.groupBy("key", "part", "parts").agg(F.collect_list("fp").alias("fps"))
    alone = chunk.where("parts = 1").select(F.lit(True).alias("same"), "fps", F.array().cast("array<long>").alias("other"))
    split = chunk.where("parts > 1").withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    pair = split.groupBy("key", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi")).agg(
        F.min(F.when(F.col("part") <= F.col("with"), F.struct("part", "fps"))).alias("a"),
        F.max(F.when(F.col("part") >= F.col("with"), F.struct("part", "fps"))).alias("b"),
    )
    # A pair whose other sub-block happens to be empty has one side only.
    pair = pair.where("a is not null and b is not null").select((F.col("lo") == F.col("hi")).alias("same"), F.col("a.fps").alias("fps"), F.col("b.fps").alias("other"))
    return alone.unionByName(pair).mapInArrow(_verify, "u long, v long")


def _join_hot(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to the one row of ``one`` (key, copies, ...) for their key.

    Keys that stand on more than 1/HOT of all ``total`` rows, fewer than HOT of
    them, are broadcast, so a hot key stays where its rows are; the others
    shuffle. No size of the input changes this.
    """
    is_hot = F.col("copies") * HOT > total
    hot, rest = one.where(is_hot).drop("copies"), one.where(~is_hot).drop("copies")
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cool.join(rest, key))


def classes(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, _qm_k1, _qm_k2, root, component_id): near-duplicate classes, root being a fingerprint that names one.

    component_id is the smallest doc_id of the class, null only if the class has
    no doc_id. Null and empty texts have fingerprint zero and link like any
    other. Every row comes back, repeated rows too.
    """
    prints = materialize(fingerprints(docs), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    parent = components(links(nodes.select("fp"), n))
    rooted = nodes.join(parent.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("copies")), "least")
    node_class = materialize(_join_hot(rooted, least, "root", n).select("fp", "root", "component_id", "copies"), "classes")
    return _join_hot(prints, node_class, "fp", total)


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each near-duplicate class.

    Rows that are equal in doc_id and text count as one document: one of them stays.
    """
    c = materialize(classes(docs), "dedup")
    key = F.struct("doc_id", "_qm_k1", "_qm_k2")
    keep = c.groupBy("root").agg(F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), key)).alias("keep"))
    kept = keep.select("keep._qm_k1", "keep._qm_k2")
    dropped = c.select("_qm_k1", "_qm_k2").distinct().join(kept, ["_qm_k1", "_qm_k2"], "left_anti")
    repeated = materialize(c.groupBy("_qm_k1", "_qm_k2").agg(F.count("*").alias("n")).where("n > 1").select("_qm_k1", "_qm_k2"), "repeats")
    rest = drop_rows(docs, dropped)
    if not repeated.count():
        return rest
    keyed, names = with_keys(rest)
    repeated = repeated.toDF(*names)
    once = keyed.join(repeated, names, "left_semi").dropDuplicates(names)
    return keyed.join(repeated, names, "left_anti").unionByName(once).drop(*names)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    c = classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
