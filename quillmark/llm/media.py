"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized through
integral images, written as NPY tiles with difference hashes.

A null text is stored like an empty one; a null medium has null features; a text
of any length is one image, 64 samples wide. Rows are independent: repeated ones
repeat their result, an empty table gives an empty one. A medium that is no
image of these formats has null features and says why in ``error``.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table, texts_of

WIDTH = 64
#: Side of an NPY tile.
TILE = 16


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit or unit * (not data))


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """Binary PGM of 8-bit samples, ``width`` a row."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(a: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit palette for (h, w), 24-bit for (h, w, 3) RGB."""
    h, w = a.shape[:2]
    bits = 8 if a.ndim == 2 else 24
    row = (w * bits // 8 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * bits // 8] = (a if a.ndim == 2 else a[:, :, ::-1]).reshape(h, -1)
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, body.size, 0, 0, 256 * (bits == 8), 0)
    return head + info + palette + body[::-1].tobytes()


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers after the magic and the offset of the samples; # starts a comment."""
    out: list[int] = []
    i = 2
    while len(out) < n:
        while data[i : i + 1].isspace() or data[i : i + 1] == b"#":
            i = data.index(b"\n", i) + 1 if data[i : i + 1] == b"#" else i + 1
        j = i
        while data[j : j + 1].isdigit():
            j += 1
        out.append(int(data[i:j]))
        i = j
    return out, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16, (h, w) or (h, w, 3); a bitmap's 1 is black, 0 here."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    (w, h, *rest), at = _netpbm_header(data, 2 if kind in (b"P1", b"P4") else 3)
    deep = rest and rest[0] > 255
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    n = int(np.prod(shape))
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255).astype(np.uint8)
    if kind == b"P1":
        bits = [c - 48 for c in data[at - 1 :] if c in b"01"][:n]
        return ((1 - np.array(bits, np.uint8)) * 255).reshape(shape).astype(np.uint8)
    if kind in (b"P2", b"P3"):
        return np.array(data[at - 1 :].split()[:n], np.int64).reshape(shape).astype(np.uint16 if deep else np.uint8)
    a = np.frombuffer(data, ">u2" if deep else np.uint8, n, at).reshape(shape)
    return a.astype(np.uint16) if deep else a


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette or 24/32-bit BMP as uint8 (h, w) if grey, else (h, w, 3) RGB."""
    start, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    row = (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    a = a if h < 0 else a[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
        rgb = palette[a]
        return rgb[:, :, 0] if (palette == palette[:, :1]).all() else rgb
    return a.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def integral(a: np.ndarray) -> np.ndarray:
    """(h + 1, w + 1) sums of everything above and to the left."""
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.float64)
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def area_resize(s: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean sample of each of h by w equal areas of the image whose integral is ``s``.

    An area's border may cut samples: the integral is linear within one.
    """
    y, x = np.linspace(0, s.shape[0] - 1, h + 1), np.linspace(0, s.shape[1] - 1, w + 1)
    j, i = np.minimum(y.astype(int), s.shape[0] - 2), np.minimum(x.astype(int), s.shape[1] - 2)
    rows = s[j] + (y - j)[:, None] * (s[j + 1] - s[j])
    at = rows[:, i] + (x - i) * (rows[:, i + 1] - rows[:, i])
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return sums / ((y[1] - y[0]) * (x[1] - x[0]))


def difference_hash(s: np.ndarray) -> str:
    """64 bits, 16 hex digits: each cell of 8 by 9 against its right neighbour."""
    a = area_resize(s, 8, 9)
    return np.packbits(a[:, :-1] < a[:, 1:]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def _encode(batches):
    for b in batches:
        data = texts_of(b, 1)
        media = [encode_pgm(pad(x)) for x in data]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded, as a lossless PGM; a null text counts as empty."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_qm_b")).mapInArrow(_encode, f"doc_id {kind}, n_bytes long, media binary")


#: Columns that take the place of a medium.
MADE = ["payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "dhash", "tile", "error"]


def _features(batches):
    for b in batches:
        i = b.schema.get_field_index("media")
        cols: list[list] = [[] for _ in range(7)]
        for m in b.column(i).to_pylist():
            try:
                a = None if m is None else decode(m)
                error = None
            except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                a, error = None, str(e) or type(e).__name__
            if a is None or not a.size:
                for c, v in zip(cols, (None,) * 6 + (error if a is None else "no samples",), strict=True):
                    c.append(v)
                continue
            payload, s = a.tobytes(), integral(grey(a))
            tile = npy(np.rint(area_resize(s, TILE, TILE)).astype(np.uint8 if a.dtype == np.uint8 else np.uint16))
            for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), hashlib.sha256(m).hexdigest(), difference_hash(s), tile, None), strict=True):
                c.append(v)
        kept = [b.column(j) for j in range(b.num_columns) if j != i]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
        names = [n for n in b.schema.names if n != "media"] + MADE
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def media_features(media: DataFrame) -> DataFrame:
    """Decode the stored ``media`` column; its place take digests of the samples read back, dhash, an NPY tile and an error.

    A null medium has null features, and so has one that no decoder takes,
    whatever its header claims. Other columns stay; those that are called like
    a new one get underscores behind their names.
    """
    small_batches(media.sparkSession)
    names = set(media.columns) | set(MADE)
    for c in [c for c in media.columns if c in MADE]:
        new = c + "_"
        while new in names:
            new += "_"
        names.add(new)
        media = media.withColumnRenamed(c, new)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    return media.mapInArrow(_features, kept + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, dhash string, tile binary, error string")


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Stores the images in the shared folder and reads them back; ``tile`` is the NPY tile itself."""
    media = materialize(text_media(table(spark, sf_dir, "documents")), "media")
    out = media_features(media.withColumn("media_bytes", F.length("media").cast("long")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature"), "tile")
