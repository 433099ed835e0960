from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from quillmark.llm import media


def test_query_is_a_lossless_round_trip(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op2_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        data = docs[r.doc_id]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.encode_pgm(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 8), (4, 6, 3), (5, 3, 3)])
def test_bmp_and_netpbm_round_trips(shape):
    a = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_bmp(a)) == a).all()
    h, w = shape[:2]
    kind, text = ("5", "2") if len(shape) == 2 else ("6", "3")
    raw = f"P{kind}\n# note\n{w} {h}\n255\n".encode() + a.tobytes()
    plain = f"P{text}\n{w} {h}\n255\n{' '.join(map(str, a.ravel()))}\n".encode()
    assert (media.decode(raw) == a).all() and (media.decode(plain) == a).all()
    deep = (a.astype(np.uint16) * 257).astype(">u2")
    assert (media.decode(f"P{kind}\n{w} {h}\n65535\n".encode() + deep.tobytes()) == deep).all()
    if len(shape) == 2:
        bits = a > 127
        p4 = f"P4\n{w} {h}\n".encode() + np.packbits(bits, axis=1).tobytes()
        p1 = f"P1\n{w} {h}\n{' '.join('1' if x else '0' for x in bits.ravel())}\n".encode()
        assert (media.decode(p4) == np.where(bits, 0, 255)).all() and (media.decode(p1) == np.where(bits, 0, 255)).all()


def test_area_resize_is_the_mean_of_each_area():
    a = np.random.default_rng(2).integers(0, 256, (12, 18)).astype(float)
    small = media.area_resize(media.integral(a), 4, 6)
    assert np.allclose(small, a.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    uneven = media.area_resize(media.integral(a), 5, 7)
    fine = np.kron(a, np.ones((35, 35)))
    assert np.allclose(uneven, fine.reshape(5, 84, 7, 90).mean(axis=(1, 3)))


def test_hash_follows_gradients():
    ramp = np.tile(np.arange(90.0), (64, 1))
    assert media.difference_hash(media.integral(ramp)) == "f" * 16 and media.difference_hash(media.integral(ramp[:, ::-1])) == "0" * 16


def test_tiles_are_readable_npy(spark, odd, nothing):
    import io

    stored = media.text_media(odd)
    out = media.media_features(stored).collect()
    assert len(out) == odd.count()
    assert all(np.load(io.BytesIO(r.tile)).shape == (16, 16) for r in out)
    same = {r.doc_id: r for r in out if r.doc_id in (40, 41)}
    assert same[40].payload_sha256 == same[41].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert media.text_media(nothing).count() == 0 and media.media_features(media.text_media(nothing)).count() == 0
    missing = spark.createDataFrame([(1, None, 5)], "id long, media binary, other int")
    row = media.media_features(missing).first()
    assert (row.id, row.other, row.dhash, row.payload_bytes) == (1, 5, None, None)


def test_broken_images_are_refused():
    for data in (b"", b"GIF89a", b"BM" + bytes(60)):
        with pytest.raises((ValueError, IndexError, Exception)):
            media.decode(data)


def test_a_malformed_medium_has_null_features_and_an_error(spark):
    rows = [(1, b"P5\n2 2\n255\nabcd"), (2, b"not an image"), (3, b"P5\n9 9\n255\nshort"), (4, b"BM"), (5, b""), (6, None), (7, b"P6\n"), (8, b"P5\n0 0\n255\n")]
    got = {r.doc_id: r for r in media.media_features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].dhash and got[1].error is None and got[6].error is None
    assert all(got[i].dhash is None and got[i].payload_sha256 is None for i in range(2, 9)) and all(got[i].error for i in (2, 3, 4, 5, 7, 8))


def test_absurd_headers_and_columns_called_like_results(spark):
    rows = [(1, b"P5 99999999999999999999 9 255\n", "x", "y", "z"), (2, media.encode_pgm(media.pad(b"abc")), "x", "y", "z"), (3, None, "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, error string, error_ string, tile string")
    out = media.media_features(df)
    assert [c for c in out.columns if c.startswith(("error", "tile"))] == ["error__", "error_", "tile_", "tile", "error"]
    got = {r.doc_id: r for r in out.collect()}
    assert all((r.error__, r.error_, r.tile_) == ("x", "y", "z") for r in got.values())
    assert got[1].error and got[1].payload_bytes is None and got[2].error is None and got[2].payload_bytes == 64 and got[3].error is None
