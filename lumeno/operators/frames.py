"""Frames, stacking order, icons of pseudo elements and what lies outside the viewport."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeno.operators import dom
from lumeno.plans.shared import written

# Tags whose leaves are content of their own.
CONTENT = (*dom.CONTROLS, "img", "object", "video", "canvas", "embed", "svg", "iframe")


def absolute_frames(frames: DataFrame) -> DataFrame:
    """page_id, frame_id, l, t, depth with offsets added up over the frames a frame stands in.

    Rows are page_id, frame_id, parent_id (null: the page itself), l, t. Each level is one join; the levels end when none has rows.
    """
    known = level = written(frames.where("parent_id IS NULL").select("page_id", "frame_id", "l", "t", F.lit(0).alias("depth")), "frames")
    while not level.isEmpty():
        up = level.select("page_id", F.col("frame_id").alias("parent_id"), F.col("l").alias("_l"), F.col("t").alias("_t"), F.col("depth").alias("_depth"))
        level = frames.join(up, ["page_id", "parent_id"]).select("page_id", "frame_id", (F.col("l") + F.col("_l")).alias("l"), (F.col("t") + F.col("_t")).alias("t"), (F.col("_depth") + 1).alias("depth"))
        level = written(level, "frames")
        known = known.unionByName(level)
    return known


#: Frames up to this many square pixels count as primitives, larger ones as groups of their own (fixed value).
LARGEST_PRIMITIVE = 150 * 30


def in_page(rects: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rectangles of all frames in the coordinates of their page: page_id, frame_id (null: the page itself), el_id, l, t, r, b and a key that is
    the element's alone on the page. offsets are those of absolute_frames; rectangles of frames without one are left out."""
    at = offsets.select("page_id", "frame_id", F.col("l").alias("_l"), F.col("t").alias("_t"))
    key = F.when(F.col("frame_id").isNull(), F.col("el_id").cast("string")).otherwise(F.concat_ws("/", F.col("frame_id").cast("string"), F.col("el_id").cast("string")))
    moved = rects.where("frame_id IS NOT NULL").join(at, ["page_id", "frame_id"])
    moved = moved.withColumns({"l": F.col("l") + F.col("_l"), "r": F.col("r") + F.col("_l"), "t": F.col("t") + F.col("_t"), "b": F.col("b") + F.col("_t")})
    both = rects.where("frame_id IS NULL").unionByName(moved.select(*rects.columns))
    return both.select("page_id", "frame_id", "el_id", key.alias("key"), *"ltrb")


def frame_kinds(iframes: DataFrame) -> DataFrame:
    """Frames with alone: whether they are groups of their own instead of primitives, by their size."""
    return iframes.withColumn("alone", (F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) > LARGEST_PRIMITIVE)


def frame_records(iframes: DataFrame, frames: DataFrame) -> DataFrame:
    """Each iframe element with the record of its frame by machine id (N7); iframes without one are left out."""
    return iframes.join(frames, ["page_id", "machine_id"])


def stacking(elements: DataFrame) -> DataFrame:
    """page_id, el_id, pre, path, zs: of every element the positions on its path of positioned ones and their z-indexes (none: 0), from the root down."""
    e = dom.paths(elements)
    own = e.where(F.col("position") != "static").select("page_id", F.col("el_id").alias("anc_id"), F.coalesce(F.col("z_index"), F.lit(0)).alias("z"))
    held = dom.above(e, "el_id", F.size("path").alias("_size")).join(own, ["page_id", "anc_id"]).groupBy("page_id", "el_id")
    zs = held.agg(F.sort_array(F.collect_list(F.struct((F.col("_size") - F.col("dist") - 1).alias("d"), "z"))).alias("zs"))
    return e.select("page_id", "el_id", "pre", "path").join(zs, ["page_id", "el_id"], "left")


def drawn_above(a: str, b: str) -> Column:
    """Whether the element with columns a + pre, path, zs is drawn over that with b + ...: one test of two rows of stacking()."""
    met = F.size(F.array_intersect(f"{a}path", f"{b}path"))
    first = lambda x: F.coalesce(F.get(F.filter(f"{x}zs", _below(met)), 0)["z"], F.lit(0))
    return (first(a) > first(b)) | ((first(a) == first(b)) & (F.col(f"{a}pre") > F.col(f"{b}pre")))


def _below(met: Column) -> Callable[[Column], Column]:
    return lambda x: x["d"] >= met


def is_above(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """page_id, a_id, b_id, above: whether the first of two elements is drawn over the second.

    Below their common ancestor the outermost positioned element of each decides by its z-index (none: 0); equal ones by document order.
    """
    s = stacking(elements)
    made = pairs
    for k in "ab":
        made = made.join(s.select("page_id", *[F.col(c).alias(f"{k}_{c}" if c != "el_id" else f"{k}_id") for c in ("el_id", "pre", "path", "zs")]), ["page_id", f"{k}_id"])
    return made.where(F.arrays_overlap("a_path", "b_path")).select("page_id", "a_id", "b_id", drawn_above("a_", "b_").alias("above"))


def pseudo_icons(elements: DataFrame) -> DataFrame:
    """page_id, el_id, kind, place of leaves without text whose pseudo elements show an icon (F20): before, else after; elements in
    controls, media or iframes are none. Rows have before_content and after_content."""
    from lumeno.operators.snapshot import pseudo_content

    parents = elements.where(F.col("parent_id").isNotNull()).select("page_id", F.col("parent_id").alias("el_id")).distinct()
    leaves = elements.join(parents, ["page_id", "el_id"], "left_anti").join(dom.with_text(elements).select("page_id", "el_id"), ["page_id", "el_id"], "left_anti")
    free = dom.outside(leaves, elements.where(F.col("tag").isin(*CONTENT)))
    before, after = pseudo_content(F.col("before_content")), pseudo_content(F.col("after_content"))
    made = free.select("page_id", "el_id", F.coalesce(before, after).alias("kind"), F.when(before.isNotNull(), "before").otherwise("after").alias("place"))
    return made.where("kind IS NOT NULL")


def outside_viewport(elements: DataFrame, width: float = 1440, height: float = 900) -> DataFrame:
    """page_id, el_id of fixed elements outside the viewport and what they hold, but for what is still within it (F32)."""
    out = (F.col("b") <= 0) | (F.col("r") <= 0) | (F.col("t") >= height) | (F.col("l") >= width)
    fixed = elements.where((F.col("position") == "fixed") & out & ~F.col("tag").isin("html", "body") & (F.col("r") - F.col("l") > 1) & (F.col("b") - F.col("t") > 1))
    return dom.inside(elements.where(out), fixed).select("page_id", "el_id")


def sampled_average(samples: DataFrame) -> DataFrame:
    """page_id, el_id, color: the average of the sampled pixels (A9); rows have rgb, an array."""
    return samples.groupBy("page_id", "el_id").agg(F.array(*[F.avg(F.get("rgb", k)) for k in range(3)]).alias("color"))


def topmost(elements: DataFrame, *by: str) -> DataFrame:
    """The el_id of the topmost and of the bottommost element of each group (O3); of equal ones the first in the document."""
    return elements.groupBy(*by).agg(F.min_by("el_id", F.struct("t", "el_id")).alias("top_id"), F.max_by("el_id", F.struct(F.col("b"), -F.col("el_id"))).alias("bottom_id"))
