"""Images as tiles (S10 to S12): rows of page_id, img_id, tx, ty, w, h (of the tile) and rgba, so that no image is ever one value once it is read.

PNG files are decoded with zlib, row by row; other formats tell their size only. Tiles can also be made of pixel rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
TILES = "page_id long, img_id long, tx int, ty int, w int, h int, rgba binary"
#: Channels of PNG color types (fixed values of the format).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_START = b"\x89PNG\r\n\x1a\n"


def _unfiltered(data: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes without their filters; step is the bytes of a pixel."""
    rows, up = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y in range(height):
        kind, raw = data[y * (stride + 1)], np.frombuffer(data, np.uint8, stride, y * (stride + 1) + 1)
        if kind == 0:
            row = raw
        elif kind == 1:
            padded = np.concatenate([raw, np.zeros(-stride % step, np.uint8)]).reshape(-1, step)
            row = np.cumsum(padded, axis=0, dtype=np.uint64).astype(np.uint8).ravel()[:stride]
        elif kind == 2:
            row = raw + up
        elif kind in (3, 4):
            row = _by_neighbours(raw.tolist(), up.tolist(), step, kind)
        else:
            raise ValueError(f"filter {kind}")
        rows[y] = up = row
    return rows


def _by_neighbours(raw: list[int], up: list[int], step: int, kind: int) -> np.ndarray:
    out = [0] * step + raw
    corner = [0] * step + up
    for k, x in enumerate(raw):
        a, b, c = out[k], up[k], corner[k]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k + step] = (x + guess) & 255
    return np.array(out[step:], np.uint8)


def decoded(png: bytes) -> np.ndarray:
    """Height by width by four bytes of a PNG file; interlaced ones and those that break the format raise ValueError."""
    if png[:8] != _START:
        raise ValueError("no PNG file")
    at, packed, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(png):
        size, name = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise ValueError("a chunk is damaged")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None or head[3] not in CHANNELS or head[6]:
        raise ValueError("this kind of PNG isn't read")
    width, height, depth, kind = head[:4]
    bits = depth * CHANNELS[kind]
    data = zlib.decompress(b"".join(packed))
    stride = (width * bits + 7) // 8
    if len(data) < height * (stride + 1):
        raise ValueError("rows are missing")
    rows = _unfiltered(data, height, stride, max(1, bits // 8))
    if depth == 16:
        values = rows.reshape(height, width, CHANNELS[kind], 2)[..., 0]
    elif depth == 8:
        values = rows.reshape(height, width, CHANNELS[kind])
    else:
        single = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, :width]
        values = (single @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
        values = values if kind == 3 else values * np.uint8(255 // ((1 << depth) - 1))
    out = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        out[..., :3], out[..., 3] = palette[values[..., 0]], alpha[values[..., 0]]
    else:
        out[..., :3] = values[..., :3] if CHANNELS[kind] > 2 else values[..., :1]
        if kind in (4, 6):
            out[..., 3] = values[..., -1]
        elif clear and depth == 8:
            key = np.frombuffer(clear, ">u2").astype(np.uint8)
            out[(values == key).all(axis=2), 3] = 0
    return out


def tiles(images: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of images (page_id, img_id, data: a PNG file); null data and files that can't be read give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, img, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    whole = decoded(data or b"")
                except (ValueError, zlib.error, struct.error, IndexError, TypeError):
                    continue
                for ty in range(0, whole.shape[0], tile):
                    part = [(page, img, tx // tile, ty // tile, *reversed(p.shape[:2]), p.tobytes()) for tx in range(0, whole.shape[1], tile) for p in [whole[ty : ty + tile, tx : tx + tile]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    names = ["page_id", "img_id", "tx", "ty", "w", "h", "rgba"]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()]
    return images.select(F.col("page_id").cast("long"), F.col("img_id").cast("long"), "data").mapInArrow(run, TILES)


def tiles_of_pixels(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of drawn pixels: one row of page_id, img_id, x, y, r, g, b, a for each point of a rectangle."""
    byte = lambda c: F.lpad(F.hex(F.col(c).cast("int")), 2, "0")
    at = pixels.select(*(F.col(c).cast("long") for c in ("page_id", "img_id")), F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty"), "x", "y", F.concat(*(byte(c) for c in "rgba")).alias("v"))
    made = at.groupBy("page_id", "img_id", "tx", "ty").agg(F.count_distinct("x").cast("int").alias("w"), F.count_distinct("y").cast("int").alias("h"), F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("all"))
    return made.select("page_id", "img_id", "tx", "ty", "w", "h", F.unhex(F.array_join(F.transform("all", lambda p: p["v"]), "")).alias("rgba"))


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height that the head of a PNG, GIF or JPEG file states."""
    data = data or b""
    if data[:8] == _START and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def native_sizes(backgrounds: DataFrame, assets: DataFrame) -> DataFrame:
    """page_id, el_id, loaded, native_w, native_h of background images (S12): rows of page_id, el_id, bg_image, l, t, r, b, and captured files (url, data).

    An SVG data address has its element's size; what was not captured or can't be read isn't loaded and has no size.
    """
    url = F.regexp_extract("bg_image", r"""url\(\s*["']?(.*?)["']?\s*\)""", 1)
    svg = F.coalesce(F.contains("url", F.lit("data:image/svg")), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [size_of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x and float(x[0]) for x in found], pa.float64()), pa.array([x and float(x[1]) for x in found], pa.float64())], names=["url", "file_w", "file_h"])

    sizes = assets.select("url", "data").mapInArrow(run, "url string, file_w double, file_h double")
    rows = backgrounds.withColumn("url", url).join(sizes, "url", "left")
    pick = lambda of, file: F.when(svg, of).otherwise(F.coalesce(file, F.lit(0.0))).cast("double")
    return rows.select("page_id", "el_id", (svg | F.col("file_w").isNotNull()).alias("loaded"), pick(F.col("r") - F.col("l"), F.col("file_w")).alias("native_w"), pick(F.col("b") - F.col("t"), F.col("file_h")).alias("native_h"))
