"""Images: decoding, tiles and what is measured on them."""

import struct
import zlib

import numpy as np
import pytest

from lumeno.operators import pixels
from lumeno.sources import pixels as source


def png(values, kind, depth, filters, palette=None, clear=None):
    """A PNG file of an array of height, width, channels, with a filter for each row."""
    height, width, channels = values.shape
    bits = depth * channels
    step, stride, up, data = max(1, bits // 8), (width * bits + 7) // 8, None, b""
    for y in range(height):
        if depth == 16:
            row = np.stack([values[y], values[y]], axis=-1).astype(np.uint8).ravel()
        elif depth == 8:
            row = values[y].astype(np.uint8).ravel()
        else:
            row = np.packbits((values[y].astype(int)[..., None] >> np.arange(depth)[::-1] & 1).astype(np.uint8).reshape(-1))
        row, above = row.tolist(), up or [0] * stride
        kind_of = filters[y % len(filters)]
        out = []
        for k, x in enumerate(row):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((x - [0, a, b, (a + b) // 2, paeth][kind_of]) & 255)
        data += bytes([kind_of, *out])
        up = row

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)) + (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + (chunk(b"tRNS", clear) if clear else b"") + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("kind", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_decoded_png(kind, depth):
    rng = np.random.default_rng(kind * 100 + depth)
    channels = source.CHANNELS[kind]
    palette = rng.integers(0, 256, (1 << min(depth, 8), 3)) if kind == 3 else None
    for _ in range(5):
        h, w = rng.integers(1, 12, 2)
        v = rng.integers(0, 1 << min(depth, 8), (h, w, channels))
        got = source.decoded(png(v, kind, depth, rng.permutation(5).tolist(), palette))
        full = palette[v[..., 0]] if kind == 3 else v * (255 // ((1 << min(depth, 8)) - 1))
        assert (got[..., :3] == (full[..., :3] if full.shape[2] > 2 else full[..., :1])).all()
        assert (got[..., 3] == (full[..., -1] if kind in (4, 6) else 255)).all()


def test_clear_colors_and_damage():
    v = np.array([[[1], [0]]])
    assert source.decoded(png(v, 3, 8, [0], np.array([[9, 9, 9], [5, 6, 7]]), b"\x40\x80")).tolist() == [[[5, 6, 7, 128], [9, 9, 9, 64]]]
    assert source.decoded(png(np.array([[[1, 2, 3], [1, 2, 4]]]), 2, 8, [0], None, struct.pack(">HHH", 1, 2, 3)))[..., 3].tolist() == [[0, 255]]
    whole = png(v, 0, 8, [0])
    for bad in (b"", b"no", whole[:40], whole[:45] + b"x" + whole[46:]):
        with pytest.raises((ValueError, struct.error, zlib.error)):
            source.decoded(bad)


def test_sizes():
    assert source.size_of(png(np.zeros((3, 5, 1)), 0, 8, [0])) == (5, 3)
    assert source.size_of(b"GIF89a" + struct.pack("<HH", 7, 4) + b"..") == (7, 4)
    assert source.size_of(b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xc2" + struct.pack(">HBHH", 11, 8, 20, 30) + b"abcdefgh") == (30, 20)
    assert source.size_of(None) is None and source.size_of(b"<svg/>") is None


def test_tiles_of_files(spark):
    rng = np.random.default_rng(2)
    v = [rng.integers(0, 256, (h, w, 4)) for h, w in ((5, 9), (1, 1), (8, 8))]
    images = spark.createDataFrame([(1, k, png(x, 6, 8, [4, 3])) for k, x in enumerate(v)] + [(2, 0, None), (2, 1, b"broken")], "page_id long, img_id long, data binary")
    t = source.tiles(images, tile=4).cache()
    assert t.where("page_id = 2").count() == 0
    for k, x in enumerate(v):
        out = np.zeros_like(x)
        for r in t.where(f"img_id = {k}").collect():
            out[r.ty * 4 : r.ty * 4 + r.h, r.tx * 4 : r.tx * 4 + r.w] = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
        assert (out == x).all()
        s = pixels.stats(t).where(f"img_id = {k}").first()
        seen = x[..., :3] * (x[..., 3:] / 255)
        assert np.allclose(s.rgb, seen.mean(axis=(0, 1))) and np.allclose(s.rgba, x.mean(axis=(0, 1))) and abs(s.sd - np.sqrt(((seen - seen.mean(axis=(0, 1))) ** 2).mean())) < 0.006
    points = spark.createDataFrame([(1, 0, 8, 4), (1, 0, 9, 0), (1, 0, -1, 2), (1, 0, 3, 5), (1, 0, 0, 0)], "page_id long, img_id long, x long, y long")
    got = {(r.x, r.y): r.rgba for r in pixels.at_points(t, points, tile=4).collect()}
    assert got == {(8, 4): v[0][4, 8].tolist(), (0, 0): v[0][0, 0].tolist()}
    same = pixels.difference(t, t).collect()
    assert len(same) == 3 and all(r.same and r.difference == 0 and r.size_difference == 0 for r in same)


def test_differing_backgrounds(spark):
    page = np.full((60, 80, 4), 255)
    page[10:30, 10:40, :3] = [200, 0, 0]
    page[40:50, 10:40, :3] = [250, 252, 252]
    t = source.tiles(spark.createDataFrame([(1, 7, png(page, 6, 8, [0]))], "page_id long, img_id long, data binary"), tile=16)
    rows = [(1, 1, 7, 10.0, 10.0, 40.0, 30.0, None, [200.0, 0.0, 0.0]), (1, 2, 7, 10.0, 40.0, 40.0, 50.0, [0.0] * 4, [250.0, 252.0, 252.0, 1.0]), (1, 3, 7, 10.0, 10.0, 40.0, 30.0, [0.0] * 4, [0.0, 0.0, 0.0, 0.0]), (1, 4, 7, 50.0, 10.0, 70.0, 30.0, None, [0.0, 0.0, 0.0, 0.2])]
    r = spark.createDataFrame(rows, "page_id long, el_id int, img_id long, l double, t double, r double, b double, borders array<double>, bg_color array<double>")
    assert {x.el_id: round(x.share, 3) for x in pixels.background_differs(r, t, 80, 60, tile=16).collect()} == {1: 1.0, 3: 1.0}


def test_native_sizes(spark):
    backgrounds = spark.createDataFrame([(1, 1, "url('a.png')"), (1, 2, 'url("data:image/svg+xml,x")'), (1, 3, "url(gone.png)"), (1, 4, None)], "page_id long, el_id int, bg_image string").selectExpr("*", "0D AS l", "0D AS t", "30D AS r", "20D AS b")
    assets = spark.createDataFrame([("a.png", png(np.zeros((3, 5, 1)), 0, 8, [0])), ("gone.png", b"404")], "url string, data binary")
    got = {r.el_id: (r.loaded, r.native_w, r.native_h) for r in source.native_sizes(backgrounds, assets).collect()}
    assert got == {1: (True, 5.0, 3.0), 2: (True, 30.0, 20.0), 3: (False, 0.0, 0.0), 4: (False, 0.0, 0.0)}
