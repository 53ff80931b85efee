import hashlib
import zlib

import numpy as np
import pytest

from corpusloom.llm import media as md


def test_query_round_trip(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = md.op5_media(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored, _ = md.text_to_media(raw.decode())
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_query_features_against_plain_means(spark, sf):
    """Difference hashes and tiles of small images, with every mean taken over pixels that are repeated until cells fit."""
    import io
    import math

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def means(x, height, width):
        h, w = x.shape[:2]
        a, b = math.lcm(h, height), math.lcm(w, width)
        fine = np.repeat(np.repeat(x.astype(float), a // h, 0), b // w, 1)
        return fine.reshape(height, a // height, width, b // width, -1).mean((1, 3))

    seen = 0
    for r in md.op5_media(spark, sf).collect():
        raw = docs[r.doc_id]
        n = max(1, -(-len(raw) // 192))
        if n > 6:
            continue
        seen += 1
        x = np.frombuffer(raw.ljust(192 * n), np.uint8).reshape(n, 64, 3)
        gray = np.round(means((x @ np.array([0.299, 0.587, 0.114]))[..., None], 8, 9)[..., 0], 6)
        bits = "".join(str(int(b > a)) for row in gray for a, b in zip(row, row[1:]))
        assert r.feature == f"{int(bits, 2):016x}"
        out = io.BytesIO()
        np.save(out, np.clip(np.rint(np.round(means(x, 32, 32), 9)), 0, 255).astype(np.uint8))
        got = np.load(io.BytesIO(md.npy_tile(x, 32)))
        assert np.abs(got.astype(int) - np.load(io.BytesIO(out.getvalue())).astype(int)).max() <= 1
        assert r.tile_sha256 == hashlib.sha256(md.npy_tile(x, 32)).hexdigest()
    assert seen > 5


def test_bit_fields():
    """16 and 32 bits a pixel, with masks and without."""
    import struct

    def bmp(depth, packed, body, masks=()):
        return struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + 4 * len(masks)) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, depth, packed, 0, 0, 0, 0, 0) + b"".join(struct.pack("<I", m) for m in masks) + body

    assert md.decode(bmp(16, 3, struct.pack("<HH", 0xF800, 0x07E0), (0xF800, 0x07E0, 0x001F))).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    assert md.decode(bmp(16, 0, struct.pack("<HH", 0x7C00, 0x001F))).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    assert md.decode(bmp(32, 3, struct.pack("<II", 0x11223300, 0xFF), (0xFF000000, 0xFF0000, 0xFF00))).tolist() == [[[17, 34, 51], [0, 0, 0]]]


@pytest.mark.parametrize("media", [b"P6 0 0 255\n", b"P5\n0 3\n255\n", b"P2 1 1 0 1", b"P5 2 2 255 a", b"BM" + bytes(60)])
def test_images_without_pixels_are_refused(media):
    with pytest.raises((ValueError, __import__("struct").error)):
        md.decode(media)


@pytest.mark.parametrize("shape", [(1, 1, 3), (5, 7, 3), (8, 64, 3)])
def test_bmp_and_ppm(shape):
    x = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    assert (md.decode(md.encode_bmp(x)) == x).all() and (md.decode(md.encode_ppm(x)) == x).all()


def test_plain_netpbm():
    assert md.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n")[..., 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert md.decode(b"P4\n3 1\n\xa0")[..., 0].tolist() == [[0, 255, 0]]
    assert md.decode(b"P2\n2 1\n15\n0 15\n")[..., 0].tolist() == [[0, 255]]
    assert md.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert md.decode(b"P5\n2 1\n65535\n\x00\x00\xff\xff")[..., 0].tolist() == [[0, 255]]


def test_area_resize_is_the_mean_over_cells():
    x = np.random.default_rng(2).integers(0, 256, (6, 10, 1)).astype(float)
    assert np.allclose(md.area_resize(x, 3, 5)[..., 0], x[..., 0].reshape(3, 2, 5, 2).mean((1, 3)))
    fine = np.repeat(np.repeat(x, 7, 0), 9, 1)
    assert np.allclose(md.area_resize(x, 7, 9)[..., 0], fine[..., 0].reshape(7, 6, 9, 10).mean((1, 3)))


def test_features():
    up = np.tile(np.arange(64, dtype=np.uint8)[None, :, None], (16, 1, 3))
    assert md.difference_hash(up) == "f" * 16 and md.difference_hash(up[:, ::-1]) == "0" * 16
    tile = np.load(__import__("io").BytesIO(md.npy_tile(up, 32)))
    assert tile.shape == (32, 32, 3) and tile.dtype == np.uint8


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "", "k"), (2, None, "k"), (3, "é" * 100_000, "k"), (3, "é" * 100_000, "k"), (None, "x", "k")], "doc_id long, text string, media string")
    packed = md.pack_texts(docs)
    rows = md.decode_media(packed, tile_side=8).collect()
    assert [r.media_error for r in rows] == [None] * 5 and rows[0].media == rows[1].media and rows[2].tile == rows[3].tile
    broken = spark.createDataFrame([(1, bytearray(b"P6 9 9 255\n")), (2, bytearray(b"GIF89a")), (3, None), (4, bytearray(b"BM"))], "doc_id long, media binary")
    got = {r.doc_id: r.media_error for r in md.decode_media(broken).collect()}
    assert got[1] and got[2] and got[3] is None and got[4]
    md.write_tiles(packed, str(tmp_path / "tiles"), tile_side=8)
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 5
    assert md.decode_media(packed.limit(0)).count() == 0
