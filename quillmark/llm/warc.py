"""WARC archives of web pages, read back by boundary-chain verification.

Writing: one text row per record; the row separator of Spark's text writer is
the two line ends that close a WARC record, so each task writes one archive to
any file system that Spark knows.

Reading: Spark's text reader splits archives at the magic of a record head,
also in the middle of a file. Each piece is a candidate record: its head gives
its length, hence the offset of its successor. The magic may also stand inside
a payload. Only what can be reached from offset 0 of its file by following
successors is a record; pointer jumping finds this in a number of rounds that
grows with the logarithm of the records in a file.

A null html is an empty payload, a null url leaves its header out, and a page
without an id is never referred to. Rows that repeat a page all come back.
Payloads are kept whole, with any bytes, line ends and record heads in them. An
empty table writes no record and reads back none. Ids are of any type that a string
can be cast back to; other columns of the pages, whatever they are called, are
not archived.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialize, remove_path, scratch_path, small_batches, table

VERSION = "WARC/1.1"
MAGIC = f"{VERSION}\r\n"
END = "\r\n\r\n"
#: Payloads below this are never revisits.
LEAST_BYTES = 100
MOST_ROUNDS = 40
#: Digests (about 100 bytes a row) that may be broadcast; beyond it each is copied to so many tasks, over which its pages are dealt.
BROADCAST_DIGESTS, SALTS = 160_000, 32


def _met(rows: DataFrame, few: DataFrame, keys: list[str], salt: list[str], n: int, broadcast: int) -> DataFrame:
    """``rows`` left joined to ``few``, of ``n`` rows, one at most for each of ``keys``: broadcast, or else salted by the columns ``salt``."""
    if n <= broadcast:
        return rows.join(F.broadcast(few), keys, "left")
    spread = few.withColumn("_qm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_qm_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).join(spread, [*keys, "_qm_salt"], "left").drop("_qm_salt")


def with_revisits(pages: DataFrame, broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """(page_id, url, _qm_payload, record_type, refers_to, digest).

    Of the pages of equal payloads of ``LEAST_BYTES`` or more, those of the
    smallest page_id are responses and the rest revisit it; rows that share
    that page_id are all responses, rows without a page_id are never referred to.
    More than ``broadcast`` repeated digests meet their pages in a salted join,
    so a page that stands on a third of all rows fills no single task.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", F.col("url").cast("string"), payload.alias("_qm_payload"))
    digest = F.sha2(F.col("_qm_payload").cast("binary"), 256)
    long = base.where(F.octet_length("_qm_payload") >= LEAST_BYTES).select("page_id", digest.alias("digest"))
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    first = materialize(first, "first")
    base = base.withColumn("digest", digest)
    joined = _met(base, first, ["digest"], ["page_id", "url"], first.count(), broadcast)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "_qm_payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"), "digest")


def _uuid(page: Column) -> Column:
    """A name for the record that depends on the page alone."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _header(name: str, value: Column) -> Column:
    """A header line, absent where the value is null; line ends and other controls in it become %-escapes' place-holder ?."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x1f\x7f]", "?")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def records(typed: DataFrame) -> DataFrame:
    """(value): the text of each record without its closing line ends."""
    size = F.octet_length("_qm_payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    block = F.when(F.col("record_type") == "response", F.concat(http, "_qm_payload")).otherwise("")
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.col("page_id")), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        _header("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("<urn:uuid:"), _uuid(F.col("refers_to")), F.lit(">")))),
        _header("X-Page-Id", F.url_encode(F.col("page_id").cast("string"))),
        _header("X-Refers-To-Page-Id", F.url_encode(F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length("_qm_block")),
        F.lit("\r\n"),
    )
    return typed.withColumn("_qm_block", block).select(F.concat(head, "_qm_block").alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one archive per task, uncompressed, so that readers can split it."""
    records(with_revisits(pages)).write.option("lineSep", END).text(path)


_FIELDS = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r$", re.M)


def _parse(piece: bytes) -> dict | None:
    """Head of a candidate record, given what follows its magic."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {k.lower(): v for k, v in _FIELDS.findall(piece[: end + 2])}
    length = head.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in head:
        return None
    return {"head": head, "body": end + 4, "length": int(length)}


def http_payload(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block


def _id(x: bytes | None) -> str | None:
    return None if x is None else unquote_plus(x.decode("ascii", "replace"))


def _digest(x: bytes | None) -> str | None:
    return x.decode("ascii", "replace").removeprefix("sha256:") if x else None


_PIECE = pa.schema(
    [
        ("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("total", pa.int64()), ("record_type", pa.string()),
        ("page_id", pa.string()), ("refers_to", pa.string()), ("named_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ]
)
_PIECE_DDL = "file string, split long, at long, size long, total long, record_type string, page_id string, refers_to string, named_digest string, payload_bytes long, payload_digest string"
_RAW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("raw", pa.binary())])


def _described(found: dict) -> dict:
    h = found["head"]
    return {
        "record_type": h[b"warc-type"].decode("ascii", "replace"), "page_id": _id(h.get(b"x-page-id")),
        "refers_to": _id(h.get(b"x-refers-to-page-id")), "named_digest": _digest(h.get(b"warc-payload-digest")),
    }


def _digested(block: bytes) -> dict:
    payload = http_payload(block)
    return {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def _numbered(batches):
    """Batches of (file, split, at, piece), ``at`` counting bytes from the split's first piece."""
    now, at = None, 0
    for b in batches:
        out = []
        for file, split, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, split) != now:
                now, at = (file, split), 0
            out.append((file, split, at, piece))
            at += len(piece) + len(MAGIC)
        yield out


def _pieces(batches):
    """Candidates in the order of the split; a piece that is just one whole record has its payload's digest."""
    for numbered in _numbered(batches):
        rows = []
        for file, split, at, piece in numbered:
            row = dict.fromkeys(_PIECE.names) | {"file": file, "split": split, "at": at, "size": len(piece) + len(MAGIC)}
            found = _parse(piece)
            if found:
                total = len(MAGIC) + found["body"] + found["length"] + len(END)
                row |= _described(found) | {"total": total}
                if total == row["size"]:
                    row |= _digested(piece[found["body"] : found["body"] + found["length"]])
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)


def _raw(batches):
    for numbered in _numbered(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*numbered, strict=True), _RAW, strict=True)], schema=_RAW) if numbered else pa.RecordBatch.from_pylist([], schema=_RAW)


def _text(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, piece): what stands between one magic and the next. The same splits each time."""
    small_batches(spark)
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with ``off``, the offset of their magic in the file.

    What stands before a file's first magic is a piece too, at a negative offset: it is empty in a sound archive.
    """
    piece = materialize(_text(spark, path).mapInArrow(_pieces, _PIECE_DDL), "pieces")
    spans = piece.groupBy("file", "split").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return piece.join(spans, ["file", "split"]).withColumn("off", F.col("base") + F.col("at") - len(MAGIC)).drop("base")


def reachable(edges: DataFrame) -> DataFrame:
    """(file, off) of the candidates on the chain of successors from offset 0.

    ``edges``: (file, off, next), at most one row per offset. A round doubles
    the length of every pointer: what is reached grows to twice as many.
    """
    state = materialize(edges.select("file", "off", "next", (F.col("off") == 0).alias("hit")), "chain")
    done = state.where("hit").count()
    for _ in range(MOST_ROUNDS):
        target = state.select("file", F.col("off").alias("next"), F.col("next").alias("after"))
        told = state.where("hit").select("file", F.col("next").alias("off"), F.lit(True).alias("told"))
        before, state = state, state.join(target, ["file", "next"], "left").join(told, ["file", "off"], "left")
        state = materialize(state.select("file", "off", F.col("after").alias("next"), (F.col("hit") | F.coalesce("told", F.lit(False))).alias("hit")), "chain")
        discard(before)
        now = state.where("hit").count()
        if now == done:
            break
        done = now
    return state.where("hit").select("file", "off")


def _assembled(batches):
    for b in batches:
        rows = []
        for file, off, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
            whole = MAGIC.encode().join(p["raw"] for p in sorted(pieces, key=lambda p: p["off"]))
            found = _parse(whole)
            rows.append({"file": file, "off": off} | _digested(whole[found["body"] : found["body"] + found["length"]]))
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("off", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))


def _mended(spark: SparkSession, path: str, c: DataFrame, odd: DataFrame) -> DataFrame:
    """(file, off, payload_bytes, payload_digest) of the ``odd`` records, whose payloads hold the magic.

    A window in the order of offsets tells which record each piece is in, on
    metadata alone; then the archives are read once more for the bytes of the
    pieces of odd records.
    """
    head = odd.select("file", "off", F.lit(True).alias("head"))
    order = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    place = c.select("file", "split", "at", "off", "total").join(head, ["file", "off"], "left")
    place = place.withColumn("rec", F.last(F.when(F.col("head"), F.struct(F.col("off").alias("o"), (F.col("off") + F.col("total")).alias("end"))), True).over(order))
    inside = materialize(place.where("off < rec.end").select("file", "split", "at", "off", F.col("rec.o").alias("rec")), "inside")
    raw = _text(spark, path).mapInArrow(_raw, "file string, split long, at long, raw binary")
    parts = raw.join(bounded_broadcast(inside, inside.count()), ["file", "split", "at"])
    whole = parts.groupBy("file", F.col("rec").alias("off")).agg(F.collect_list(F.struct(F.col("off"), "raw")).alias("pieces"))
    return whole.mapInArrow(_assembled, "file string, off long, payload_bytes long, payload_digest string")


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(page_id, record_type, refers_to, named_digest, payload_bytes, payload_digest): every record, in no order.

    payload_* are those of the bytes read; a revisit's own payload is empty. A
    record cut off by the end of its file is digested as far as it goes. Ids
    are of ``id_type``, null where a record has none of that type.
    """
    c = materialize(candidates(spark, path), "candidates")
    chain = reachable(c.where("total is not null and off >= 0").select("file", "off", (F.col("off") + F.col("total")).alias("next")))
    found = materialize(c.join(chain, ["file", "off"]).select("file", "off", "total", *_FOUND), "found")
    whole, odd = found.where("payload_digest is not null").select(*_FOUND), found.where("payload_digest is null")
    if not odd.isEmpty():
        mended = _mended(spark, path, c, odd)
        whole = whole.unionByName(odd.drop("payload_bytes", "payload_digest").join(mended, ["file", "off"]).select(*_FOUND))
    return whole.withColumns({x: F.col(x).try_cast(id_type) for x in ("page_id", "refers_to")})


_FOUND = ["page_id", "record_type", "refers_to", "named_digest", "payload_bytes", "payload_digest"]


def round_trip(pages: DataFrame, broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """Write ``pages`` as archives to the shared folder, read them back and resolve revisits.

    (page_id, payload_bytes, payload_digest, record_type, refers_to) per page,
    ids of their type in ``pages``; a revisit has the size and digest that were
    read for the response it names. More than ``broadcast`` such responses meet
    their revisits in a salted join.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    rec = materialize(read_archives(spark, path, kind), "records")
    remove_path(spark, path)
    keys = ["refers_to", "payload_digest"]
    revisit = rec.where("record_type = 'revisit'").select("page_id", "refers_to", F.col("named_digest").alias("payload_digest"))
    response = rec.where("record_type = 'response'")
    full = response.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    full = materialize(full.join(revisit.select(*keys).distinct(), keys, "left_semi"), "named")
    resolved = _met(revisit, full, keys, ["page_id"], full.count(), broadcast)
    resolved = resolved.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return response.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(kind).alias("refers_to")).unionByName(resolved)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
