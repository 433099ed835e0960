"""JPEG files read back by Spark's image source, EXIF orientation, and intake by content."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import jpeg
from quillmark.sources import images


def exif(orientation: int, order: str, before: int = 1) -> bytes:
    """A JPEG's start with a directory of ``before`` other entries and the orientation."""
    entries = b"".join(struct.pack(order + "HHI", 0x0100 + i, 3, 1) + struct.pack(order + "HH", 7, 0) for i in range(before))
    entries += struct.pack(order + "HHI", 0x0112, 3, 1) + struct.pack(order + "HH", orientation, 0)
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", before + 1) + entries + struct.pack(order + "I", 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def read_back(spark, folder, files: dict[str, bytes]) -> dict[str, np.ndarray]:
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    rows = spark.read.format("image").load(str(folder)).select("image.*").collect()
    out = {}
    for r in rows:
        a = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
        out[r.origin.split("/")[-1]] = a[:, :, 0] if r.nChannels == 1 else a[:, :, ::-1]
    return out


def test_files_are_read_back_within_small_errors(spark, tmp_path):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:203, 0:317]
    colour = np.stack([x * 255 // 317, y * 255 // 203, (x + y) // 3 % 256], axis=2).astype(np.uint8)
    page = np.where((x // 9 + y // 7) % 2, 255, 20).astype(np.uint8)
    cases = {
        "colour.jpg": (colour, 90, 1.0), "low.jpg": (colour, 30, 6.0), "page.jpg": (page, 90, 4.0), "noise.jpg": (rng.integers(0, 256, (64, 61)).astype(np.uint8), 100, 1.0),
        "one.jpg": (np.full((1, 1), 77, np.uint8), 90, 3.0), "white.jpg": (np.full((9, 30, 3), 255, np.uint8), 70, 1.0), "sparse.jpg": (np.where(rng.random((40, 40)) < 0.01, 0, 255).astype(np.uint8), 95, 3.0),
    }
    files = {n: jpeg.encode(a, q) for n, (a, q, _) in cases.items()}
    got = read_back(spark, tmp_path / "jpeg", files)
    for n, (a, _, most) in cases.items():
        assert got[n].shape == a.shape and np.abs(got[n].astype(int) - a).mean() <= most, n
    assert len(files["low.jpg"]) < len(files["colour.jpg"]) < colour.size / 4


def test_code_lengths_stay_within_16_bits_and_make_a_code():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for counts in ({i: n for i, n in enumerate(fibonacci)}, {3: 5}, {i: 1 for i in range(162)}):
        lengths = jpeg.code_lengths(counts)
        assert {s for s, _ in lengths} == set(counts) and max(n for _, n in lengths) <= 16
        assert sum(2.0**-n for _, n in lengths) < 1


def test_sides_beyond_the_format_are_refused():
    with pytest.raises(ValueError, match="sides"):
        jpeg.encode(np.zeros((0, 3), np.uint8), 90)


def test_orientation_in_both_byte_orders_and_its_absence(spark):
    rows = [(exif(n, o, k), n if 1 <= n <= 8 else 1) for n in range(10) for o in "<>" for k in (0, 3)]
    whole = exif(6, "<")
    rows += [(whole[:k], None) for k in range(len(whole))] + [(b"", 1), (None, 1), (b"Exif\0\0II*\0", 1), (b"\xff\xd8\xff\xe0plain", 1)]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "i int, content binary")
    got = {r[0]: r[1] for r in df.select("i", images.orientation_of(F.col("content"))).collect()}
    for i, (_, want) in enumerate(rows):
        assert got[i] in (1, 6) if want is None else got[i] == want, i


def test_turned_photographs_stand_upright(spark, tmp_path):
    a = np.zeros((24, 16), np.uint8)
    a[:8, :8] = 250
    # How the sensor holds the picture for each orientation.
    held = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, 1), 7: a[::-1, ::-1].T, 8: np.rot90(a, 3)}
    for n, pixels in held.items():
        assert (images.upright(pixels, n) == a).all(), n
    rows = [(str(n), *p.shape, 1, p.tobytes(), n) for n, p in held.items()]
    df = spark.createDataFrame(rows, "sheet_id string, height int, width int, n_channels int, data binary, orientation int")
    files = {r.sheet_id + ".jpg": bytes(r.full) for r in images.prepared(df).collect()}
    for n, got in read_back(spark, tmp_path / "turned", files).items():
        assert np.abs(got.astype(int) - a).mean() < 3, n


def test_prepared_sizes_transparency_and_bad_rows(spark, tmp_path):
    big = np.full((2000, 500), 200, np.uint8)
    clear = np.zeros((8, 8, 4), np.uint8)
    rows = [("big", 2000, 500, 1, big.tobytes()), ("clear", 8, 8, 4, clear.tobytes()), ("none", None, None, None, None), ("bad", -1, -1, -1, b""), ("short", 9, 9, 3, b"xx")]
    got = {r.sheet_id: r for r in images.prepared(spark.createDataFrame(rows, "sheet_id string, height int, width int, n_channels int, data binary")).collect()}
    assert [got[k].error is None for k in ("big", "clear", "none", "bad", "short")] == [True, True, False, False, False]
    back = read_back(spark, tmp_path / "p", {"full.jpg": bytes(got["big"].full), "thumb.jpg": bytes(got["big"].thumb), "clear.jpg": bytes(got["clear"].full)})
    assert back["full.jpg"].shape == (1600, 400) and back["thumb.jpg"].shape == (220, 55)
    assert (back["clear.jpg"] == 255).all()
    sizes = spark.createDataFrame([(bytes(got["big"].full),), (b"xx",), (None,)], "f binary").select(images.jpeg_size(F.col("f")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in sizes] == [(1600, 400), None, None]


def test_intake_keeps_files_without_a_type_and_counts_what_is_no_image(spark):
    rows = [("a", "", exif(3, ">")), ("b", None, b"\x89PNG\r\n\x1a\n..."), ("c", "text/html", b"\x89PNG\r\n\x1a\n"), ("d", "image/png", b"<html>"), ("e", "image/x", b""), ("f", "image/webp", b"RIFF1234WEBPVP8 "), ("g", "image/gif", None)]
    got = {r.path: (r.kind, r.orientation, r.accepted) for r in images.taken_in(spark.createDataFrame(rows, "path string, mime string, content binary")).collect()}
    assert got == {"a": ("image/jpeg", 3, True), "b": ("image/png", 1, True), "d": (None, 1, False), "e": (None, 1, False), "f": ("image/webp", 1, True), "g": (None, 1, False)}


def test_many_small_images_are_few_tasks_and_come_back_in_batches(spark):
    from quillmark.operators import scanning

    rows = [(f"s{i}", *((8, 8, 1, bytes([i % 251]) * 64) if i % 9 else (-1, -1, -1, b""))) for i in range(3000)]
    dealt = scanning.spread(spark.createDataFrame(rows, "sheet_id string, height int, width int, n_channels int, data binary"), len(rows), each=500)
    assert dealt.rdd.getNumPartitions() == max(6, spark.sparkContext.defaultParallelism)
    got = {r.sheet_id: r for r in images.prepared(dealt).collect()}
    assert len(got) == len(rows)
    for name, height, _, _, data in rows[::37]:
        want = jpeg.encode(np.frombuffer(data, np.uint8).reshape(8, 8), 90) if height > 0 else None
        assert (got[name].full and bytes(got[name].full)) == want and (got[name].error is None) == (height > 0)
