"""Shared helpers: the cluster's shared folder, row keys, guarded broadcasts, samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of (two longs or so) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of one Arrow batch sent to Python, so that long texts stay bounded.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

KEYS = ["_qm_k1", "_qm_k2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the Python stages planned from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir.

    Only a local master that names none (as in tests) has one made.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='qm-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_remove_local, root)
    return root.rstrip("/")


def _remove_local(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._qm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which no later plan reads."""
    remove_path(df.sparkSession, df._qm_path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application's operators wrote to the shared folder."""
    remove_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def row_keys(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """128 bits that tell rows apart even where doc_id is null or repeated."""
    return [F.xxhash64(doc_id, text).alias(KEYS[0]), F.xxhash64(text, doc_id).alias(KEYS[1])]


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text) keys are in ``keys``.

    The columns of ``docs`` come back unchanged, whatever they are called.
    """
    keys = materialize(keys.select(*KEYS).distinct(), "drop")
    keyed, names = with_keys(docs)
    keys_as = keys.toDF(*names)
    return keyed.join(bounded_broadcast(keys_as, keys.count()), names, "left_anti").drop(*names)


def with_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its row keys, under names that it does not use yet."""
    names = list(KEYS)
    while set(names) & set(docs.columns):
        names = [f"{n}_" for n in names]
    return docs.withColumns(dict(zip(names, row_keys(), strict=True))), names


def remainder(k: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal doc_id, modulo k; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(k)


def held_out(k: int, r: int) -> Column:
    return F.coalesce(remainder(k) == r, F.lit(False))


def learned_from(k: int, r: int) -> Column:
    return F.coalesce(remainder(k) != r, F.lit(False))


def labelled_rows(docs: DataFrame, known: DataFrame, most_rows: int) -> DataFrame:
    """Stored (_qm_k1, _qm_k2, _qm_size, doc_id, labels..., _qm_more): at most ``most_rows`` labelled texts, by the hash of doc_id.

    Labels meet texts before the bound, and each doc_id first has one text for
    each of its distinct labels, that of the least hash; what room is left
    other texts of these doc_ids fill (_qm_more is 1). So repeated labels,
    labels of absent documents or null texts, and doc_ids on very many rows
    take no place from others. Texts meet in partial sums before anything is
    shuffled. Rows equal in doc_id and text are one.
    """
    cols = [c for c in known.columns if c != "doc_id"]
    full = docs.where(F.col("text").isNotNull()).select("doc_id", *row_keys(), F.octet_length("text").alias("_qm_size"))
    first = full.groupBy("doc_id").agg(F.min(F.struct(*KEYS, "_qm_size")).alias("_qm_t")).join(known.distinct(), "doc_id")
    first = first.orderBy(F.xxhash64("doc_id"), "doc_id", *cols).limit(most_rows).select("_qm_t.*", "doc_id", *cols, F.lit(0).alias("_qm_more"))
    first = materialize(first, "labelled")
    left = most_rows - first.count()
    if not left:
        return first
    picked = first.select("doc_id", *cols).distinct()
    others = full.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi").distinct().join(F.broadcast(first.select(*KEYS).distinct()), KEYS, "left_anti")
    others = others.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), *KEYS, *cols).limit(left)
    return materialize(first.unionByName(others.withColumn("_qm_more", F.lit(1))), "labelled")


def whole_texts(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(doc_id, labels..., _qm_b) of the texts of ``labelled_rows``, which are few; rows equal in doc_id and text are one."""
    texts = docs.select(*row_keys(), F.col("text").cast("binary").alias("_qm_b")).join(F.broadcast(some.select(*KEYS).distinct()), KEYS, "left_semi").dropDuplicates(KEYS)
    return texts.join(F.broadcast(some), KEYS).drop(*KEYS, "_qm_size", "_qm_more")


def sample_texts(docs: DataFrame, known: DataFrame, most_rows: int, most_bytes: int) -> list:
    """(doc_id, text, labels...) of ``labelled_rows`` with their whole texts.

    They are taken in the order of their hashes, whatever their lengths, until
    the texts before hold ``most_bytes``; both bounds hold before any text is
    collected. Sorted, so that a rerun learns the same model.
    """
    cols = [c for c in known.columns if c != "doc_id"]
    sizes = labelled_rows(docs, known, most_rows)
    before = Window.orderBy("_qm_more", *KEYS, *cols).rowsBetween(Window.unboundedPreceding, -1)
    # The window's one task holds most_rows rows of a few numbers.
    some = sizes.withColumn("_qm_before", F.coalesce(F.sum("_qm_size").over(before), F.lit(0))).where(F.col("_qm_before") < most_bytes).drop("_qm_before")
    rows = whole_texts(docs, materialize(some, "sample")).select("doc_id", "_qm_b", *cols).collect()
    return sorted(((r[0], bytes(r[1]), *r[2:]) for r in rows), key=lambda r: (r[0], r[1], *r[2:]))


def texts_of(batch: pa.RecordBatch, i: int) -> list[bytes]:
    """UTF-8 bytes of column ``i``, null as empty."""
    col = batch.column(i)
    if not (pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]
