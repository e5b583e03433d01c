"""Measures of tiled images (A8 to A10, F22): tiles are summed or compared one by one, points meet the tile they lie in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeno.functions import color as C
from lumeno.operators import boxes
from lumeno.sources.pixels import TILE

KEYS = ["page_id", "img_id"]
#: The share of outside points whose color has to differ from a background (fixed value), and the opacity from which on it is its own.
SHARE, OWN_ALPHA = 1 / 3, 0.05


def _seen(rgba: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A tile's pixels, and their colors by alpha, as on black."""
    x = np.frombuffer(rgba, np.uint8).reshape(-1, 4).astype(np.float64)
    return x, x[:, :3] * (x[:, 3:] / 255)


def stats(tiles: DataFrame) -> DataFrame:
    """page_id, img_id, n, rgb (mean color by alpha), rgba (mean of all channels), sd (over pixels and channels, two digits) of images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(2).to_pylist():
                x, seen = _seen(raw)
                rows.append([float(len(x)), *x.sum(axis=0), *seen.sum(axis=0), *(seen * seen).sum(axis=0)])
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in cols)], names=[*KEYS, *names])

    names = ["n", *(f"s_{c}" for c in "rgba"), *(f"p_{c}" for c in "rgb"), *(f"q_{c}" for c in "rgb")]
    parts = tiles.select(*(F.col(c).cast("long") for c in KEYS), "rgba").mapInArrow(run, "page_id long, img_id long, " + ", ".join(f"{n} double" for n in names))
    total = parts.groupBy(*KEYS).agg(*[F.sum(n).alias(n) for n in names])
    mean = lambda c: F.col(c) / F.col("n")
    spread = sum((mean(f"q_{c}") - mean(f"p_{c}") * mean(f"p_{c}") for c in "rgb"), F.lit(0.0)) / 3
    return total.select(*KEYS, F.col("n").cast("long").alias("n"), F.array(*[mean(f"p_{c}") for c in "rgb"]).alias("rgb"), F.array(*[mean(f"s_{c}") for c in "rgba"]).alias("rgba"), F.round(F.sqrt(F.greatest(spread, F.lit(0.0))), 2).alias("sd"))


def difference(one: DataFrame, two: DataFrame, tolerance: float = 2) -> DataFrame:
    """page_id, img_id, same, difference, size_difference of two versions of images (A10): points differ if their colors by alpha do by more than
    the tolerance in all; difference sums what they differ by, and counts 255 for each channel of a point that only the first one has (less for one that only the second has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, wa, wb in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                pixels = [0 if x is None else len(x) // 4 for x in (a, b)]
                total = 0.0
                if a is not None and b is not None:
                    p, q = (_seen(x)[1].reshape(-1, w, 3) for x, w in ((a, wa), (b, wb)))
                    h, w = min(len(p), len(q)), min(wa, wb)
                    apart = np.abs(p[:h, :w] - q[:h, :w]).sum(axis=2)
                    total = float(apart[apart > tolerance].sum())
                rows.append((total, *pixels))
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int64(), pa.int64())))], names=[*KEYS, "d", "n1", "n2"])

    at = [*KEYS, "tx", "ty"]
    side = lambda df, k: df.select(*(F.col(c).cast("long") for c in at), F.col("rgba").alias(f"rgba_{k}"), F.col("w").alias(f"w_{k}"))
    both = side(one, 1).join(side(two, 2), at, "full").select(*KEYS, "rgba_1", "rgba_2", "w_1", "w_2")
    total = both.mapInArrow(run, "page_id long, img_id long, d double, n1 long, n2 long").groupBy(*KEYS).agg(F.sum("d").alias("d"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    more = F.col("n1") - F.col("n2")
    return total.select(*KEYS, (F.col("d") == 0).alias("same"), (F.col("d") + 3 * 255 * more).alias("difference"), (4 * F.abs(more)).alias("size_difference"))


def at_points(tiles: DataFrame, points: DataFrame, tile: int = TILE) -> DataFrame:
    """points (page_id, img_id, x, y, ...) with rgba, the color there as an array of 0 to 255; points outside their image are left out."""
    dealt = points.withColumns({"tx": F.floor(F.col("x") / tile).cast("int"), "ty": F.floor(F.col("y") / tile).cast("int")})
    met = dealt.join(tiles.select(*KEYS, "tx", "ty", "w", "h", F.col("rgba").alias("_raw")), [*KEYS, "tx", "ty"])
    x, y = F.col("x") - F.col("tx") * tile, F.col("y") - F.col("ty") * tile
    start = ((y * F.col("w") + x) * 4 + 1).cast("int")
    channel = lambda k: F.conv(F.hex(F.substring("_raw", start + k, F.lit(1))), 16, 10).cast("double")
    return met.where((x < F.col("w")) & (y < F.col("h")) & (F.col("x") >= 0) & (F.col("y") >= 0)).withColumn("rgba", F.array(*[channel(k) for k in range(4)])).drop("tx", "ty", "w", "h", "_raw")


def average(points: DataFrame, *by: str) -> DataFrame:
    """The mean of the sampled colors, by group."""
    return points.groupBy(*by).agg(F.array(*[F.avg(F.get("rgba", k)) for k in range(3)]).alias("color"))


def _inside(rects: DataFrame) -> DataFrame:
    """Four points just within the border at the middle of each side."""
    mid = {"x": F.floor((F.col("l") + F.col("r")) / 2 + 0.5), "y": F.floor((F.col("t") + F.col("b")) / 2 + 0.5)}
    edge = lambda c, k, sign: F.floor(F.col(c) + sign * (F.coalesce(F.get("borders", k), F.lit(0.0)) + 1))
    points = [(mid["x"], edge("t", 0, 1)), (mid["x"], edge("b", 2, -1)), (edge("l", 3, 1), mid["y"]), (edge("r", 1, -1), mid["y"])]
    return rects.select("page_id", "el_id", "img_id", F.explode(F.array(*[F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")) for x, y in points])).alias("p")).select("page_id", "el_id", "img_id", "p.*")


def background_differs(rects: DataFrame, tiles: DataFrame, doc_width: float, doc_height: float, tile: int = TILE) -> DataFrame:
    """page_id, el_id, share of elements whose background differs from at least a third of the points sampled around them.

    rects are page_id, el_id, img_id (the page's image), l, t, r, b, borders (top, right, bottom, left) and bg_color. A color that is all but
    opaque is taken as it is, others from the image, as the mean of points just within the borders.
    """
    alpha = F.coalesce(F.get("bg_color", 3), F.lit(1.0))
    own = rects.where(alpha >= 1 - OWN_ALPHA).select("page_id", "el_id", F.slice("bg_color", 1, 3).alias("color"))
    seen = average(at_points(tiles, _inside(rects.where(alpha < 1 - OWN_ALPHA)), tile), "page_id", "el_id")
    around = boxes.outside_samples(rects, doc_width, doc_height).join(rects.select("page_id", "el_id", "img_id"), ["page_id", "el_id"])
    points = at_points(tiles, around, tile).join(own.unionByName(seen), ["page_id", "el_id"])
    share = F.avg(C.differ(F.col("rgba"), F.col("color")).cast("double"))
    return points.groupBy("page_id", "el_id").agg(share.alias("share")).where(F.col("share") >= SHARE)
