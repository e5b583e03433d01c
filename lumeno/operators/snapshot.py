"""Captured elements (snapshots): visibility, collections, pixels.

A snapshot row has what a browser knew: page_id, el_id, parent_id, tag, pre, post, depth, own_text, attrs, display, position,
visibility, opacity, overflow (visible, hidden, ...), l, t, r, b, font_size, font_weight, color, bg_color (arrays), bg_image,
border widths and colors (arrays of top, right, bottom, left), cursor, hover_styled, z_index, doc_width, doc_height.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeno.functions import color as C
from lumeno.functions import geometry as G
from lumeno.operators import dom
from lumeno.plans.shared import once

# Fixed values.
MEDIA = ("img", "object", "video", "canvas", "embed", "svg")
NO_CONTROL_IN = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "cite", "code", "q", "rb", "var")
MIN_OPACITY, MIN_ALPHA, MIN_FONT = 0.1, 0.05, 3


def box(df: DataFrame | None = None) -> dict[str, Column]:
    return {k: F.col(k) for k in "ltrb"}


def width() -> Column:
    return F.col("r") - F.col("l")


def height() -> Column:
    return F.col("b") - F.col("t")


def _rect(l: Column, t: Column, r: Column, b: Column) -> Column:
    return F.struct(*[c.cast("double").alias(k) for k, c in zip("ltrb", (l, t, r, b))])


def _meet(box: Column, clip: Column) -> Column:
    """What of a box is within a clip; an empty part lies at its corner."""
    l, t = F.greatest(box["l"], clip["l"]), F.greatest(box["t"], clip["t"])
    return _rect(l, t, F.greatest(F.least(box["r"], clip["r"]), l), F.greatest(F.least(box["b"], clip["b"]), t))


def _clip_step(state: Column, x: Column) -> Column:
    """The clips below an element x, given those above it, and what of its own box they leave."""
    own = F.when(x["position"] == "fixed", state["fixed"]).when(x["position"] == "absolute", state["lifted"]).otherwise(state["flow"])
    cut = _meet(x["box"], own)
    below = F.when(x["clips"], cut).otherwise(own)
    held = x["moved"] | (x["position"] != "static")
    return F.struct(below.alias("flow"), F.when(held, below).otherwise(state["lifted"]).alias("lifted"), F.when(x["moved"], below).otherwise(state["fixed"]).alias("fixed"), cut.alias("cut"))


def clipped(elements: DataFrame) -> DataFrame:
    """Boxes within all clipping ancestors and the document as cl, ct, cr, cb (F2).

    Flow elements are clipped by every clipping ancestor, absolute ones by those that are the nearest positioned one or above it,
    fixed ones by none; an ancestor with a transform (column transform, if there is one) counts as positioned, and holds fixed ones as well.
    A fold over the elements of the path, from the root down, whose state is the clip for each kind of position.
    """
    e = dom.paths(elements)
    moved = F.coalesce(F.col("transform"), F.lit("none")) != "none" if "transform" in e.columns else F.lit(False)
    clips = F.coalesce("overflow", F.lit("visible")) != "visible"
    facts = e.select("page_id", F.col("el_id").alias("anc_id"), F.struct(_rect(*(F.col(k) for k in "ltrb")).alias("box"), F.coalesce("position", F.lit("static")).alias("position"), clips.alias("clips"), moved.alias("moved")).alias("x"))
    lines = dom.above(e, "el_id").join(facts, ["page_id", "anc_id"]).groupBy("page_id", "el_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("k"), "anc_id", "x"))).alias("line"))
    whole = _rect(F.lit(0.0), F.lit(0.0), F.col("doc_width"), F.col("doc_height"))
    start = F.struct(*[whole.alias(k) for k in ("flow", "lifted", "fixed", "cut")])
    cut = F.aggregate("line", start, lambda s, y: _clip_step(s, y["x"]), lambda s: s["cut"])
    return elements.join(lines, ["page_id", "el_id"]).withColumn("_cut", cut).select(*elements.columns, *[F.col(f"_cut.{k}").alias(f"c{k}") for k in "ltrb"])


def visible(elements: DataFrame) -> DataFrame:
    """Elements that can be seen (F1), with clipped boxes cl, ct, cr, cb."""
    e = clipped(elements)
    w, h = F.col("cr") - F.col("cl"), F.col("cb") - F.col("ct")
    seen = e.where((F.col("display") != "none") & (width() * height() > 0.99) & (F.coalesce("visibility", F.lit("visible")) == "visible") & (w * h > 2) & (w >= 1) & (h >= 1) & (F.col("cr") > -3) & (F.col("cb") > -3))
    seen = dom.outside(seen, elements.where("tag = 'svg'"), strict=True)
    hidden = elements.where((F.coalesce("opacity", F.lit(1.0)) < MIN_OPACITY) | F.col("tag").isin("map", "area") | (F.col("display") == "none"))
    return dom.outside(seen, hidden)


def visible_text(elements: DataFrame) -> DataFrame:
    """Elements whose own text can be read."""
    alpha = F.coalesce(F.get("color", 3), F.lit(1.0))
    return dom.with_text(elements).where((F.col("font_size") > MIN_FONT) & (alpha > MIN_ALPHA))


def graphics(elements: DataFrame) -> DataFrame:
    """Graphics with kind: ui, icon, main; bg.* for background images."""
    w, h = width(), height()
    real = F.col("tag").isin(*MEDIA)
    kind = lambda is_real: F.when(G.is_ui(w, h, is_real), "ui").when(G.is_icon(w, h, is_real), "icon").otherwise("main")
    background = F.col("bg_image").isNotNull() & (F.col("bg_image") != "none")
    return elements.where(real | background).withColumn("kind", F.when(real, kind(True)).otherwise(F.concat(F.lit("bg."), kind(False))))


def pseudo_content(content: Column) -> Column:
    """img, glyph or null for the content of a pseudo element."""
    inner = F.regexp_replace(content, "^[\"']|[\"']$", "")
    return F.when(F.startswith(content, F.lit("url(")), "img").when((F.length(inner) == 1) & F.regexp_like(inner, F.lit("[\\ue000-\\uf8ff\\u2190-\\u2bff]")), "glyph")


def bordered(elements: DataFrame) -> DataFrame:
    """page_id, el_id, side, width of every visible border side (F21): some width, not transparent, another color than inside."""
    sides = elements.select("page_id", "el_id", "bg_color", F.posexplode(F.arrays_zip(F.col("border_widths").alias("w"), F.col("border_colors").alias("c"))).alias("k", "s"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("top", "right", "bottom", "left")]), F.col("k") + 1)
    alpha = F.coalesce(F.get(F.col("s.c"), 3), F.lit(1.0))
    inside_clear = F.coalesce(F.get("bg_color", 3), F.lit(1.0)) < MIN_ALPHA
    return sides.where((F.col("s.w") > 0) & (alpha >= MIN_ALPHA) & (inside_clear | C.differ(F.col("s.c"), F.col("bg_color")))).select("page_id", "el_id", name.alias("side"), F.col("s.w").alias("width"))


def background_differs(samples: DataFrame) -> DataFrame:
    """page_id, el_id of elements whose background differs from at least a third of the sampled points outside (F22): rows of inside and outside colors."""
    share = F.avg(C.differ(F.col("inside"), F.col("outside")).cast("double"))
    return samples.groupBy("page_id", "el_id").agg(share.alias("share")).where(F.col("share") >= 1 / 3).select("page_id", "el_id")


def positioned(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("position").isin("relative", "absolute", "fixed", "sticky") & ~F.col("tag").isin("html", "body"))


@once
def computed_controls(elements: DataFrame, page_width: float = 1440) -> DataFrame:
    """Small clickable things that aren't native controls (F12): pointer, hover style or link, not in running text, without other
    clickable or large media inside, with at most one text; outermost only."""
    most, least = max(0.13 * page_width, 120), max(0.041 * page_width, 50)
    native = dom.native_controls(elements)
    click = elements.where(((F.col("cursor") == "pointer") | F.coalesce("hover_styled", F.lit(False)) | (F.col("tag") == "a")) & ~F.col("tag").isin(*dom.CONTROLS, *dom.DECORATIVE, "form", "label"))
    click = click.where((F.greatest(width(), height()) < most) & (F.least(width(), height()) < least))
    click = dom.outside(click, elements.where(F.col("tag").isin(*NO_CONTROL_IN)))
    click = dom.outside(click, elements.where("tag = 'a'"), strict=True)
    big = graphics(elements).where("kind in ('main', 'bg.main')")
    texts = dom.members(click.withColumn("group_id", F.col("el_id")), dom.with_text(elements)).groupBy("page_id", F.col("group_id").alias("el_id")).agg(F.count("*").alias("n")).where("n > 1")
    holds = dom.members(click.withColumn("group_id", F.col("el_id")), big.unionByName(native, allowMissingColumns=True)).select("page_id", F.col("group_id").alias("el_id"))
    return dom.outermost(click.join(texts, ["page_id", "el_id"], "left_anti").join(holds, ["page_id", "el_id"], "left_anti"))


@once
def primitives(elements: DataFrame) -> DataFrame:
    """page_id, el_id, family of texts outside computed controls, graphics outside any control, and all controls."""
    computed, native = computed_controls(elements), dom.native_controls(elements)
    keys = ["page_id", "el_id"]
    texts = dom.outside(visible_text(elements), computed).select(*keys, F.lit("txt").alias("family"))
    pics = dom.outside(graphics(elements).where("kind not in ('bg.main')"), computed.unionByName(native)).select(*keys, F.lit("graphic").alias("family"))
    both = native.select(*keys).union(computed.select(*keys)).distinct().select(*keys, F.lit("cntrl").alias("family"))
    return texts.unionByName(pics).unionByName(both)


def primitive_sets(elements: DataFrame, computed: DataFrame, icons: DataFrame | None = None, edged: DataFrame | None = None, overlays: DataFrame | None = None) -> DataFrame:
    """page_id, el_id, family (txt, graphic, cntrl, edge), plain, grouped: the elements of both named sets.

    plain is text, native controls and graphics. grouped knows computed controls: text outside them, graphics outside any control, and all
    controls. Icons of pseudo elements (F20) are graphics; edged elements, with a border or a background of their own (F21, F22), are in
    both sets; with overlays, what stands in one is in none. An element may be of several families.
    """
    keys = ["page_id", "el_id"]
    native = dom.native_controls(elements)
    pics = graphics(elements).where("kind <> 'bg.main'").select(*keys)
    pics = pics if icons is None else pics.unionByName(icons.select(*keys)).distinct()
    made = visible_text(elements).select(*keys, F.lit("txt").alias("family")).unionByName(native.select(*keys, F.lit("cntrl").alias("family"))).unionByName(pics.select(*keys, F.lit("graphic").alias("family")))
    made = made.withColumn("plain", F.lit(True)).unionByName(computed.select(*keys, F.lit("cntrl").alias("family"), F.lit(False).alias("plain")))
    if edged is not None:
        made = made.unionByName(edged.select(*keys, F.lit("edge").alias("family"), F.lit(True).alias("plain")))
    made = made.groupBy(*keys, "family").agg(F.bool_or("plain").alias("plain"))
    within = lambda of, name: dom.inside(elements, of).select(*keys, F.lit(True).alias(name))
    made = made.join(within(computed, "_computed"), keys, "left").join(within(native.select(*keys).unionByName(computed.select(*keys)), "_control"), keys, "left")
    stays = F.when(F.col("family") == "txt", F.col("_computed").isNull()).when(F.col("family") == "graphic", F.col("_control").isNull()).otherwise(F.lit(True))
    made = made.withColumn("grouped", stays).drop("_computed", "_control").where("plain OR grouped")
    return made if overlays is None else made.join(within(overlays, "_over").drop("_over"), keys, "left_anti")


def full_window(elements: DataFrame, page_width: float = 1440, page_height: float = 900) -> DataFrame:
    """Ids of graphics as large as the window and as the document, by page."""
    g = graphics(elements)
    covers = lambda w, h: (width() >= w) & (height() >= h)
    return g.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(covers(page_width, page_height), F.col("el_id").cast("string")))), "__").alias("window_ids"), F.array_join(F.sort_array(F.collect_list(F.when(covers(F.col("doc_width"), F.col("doc_height")), F.col("el_id").cast("string")))), "__").alias("document_ids"))


def inherited_style(elements: DataFrame, styled: DataFrame) -> DataFrame:
    """page_id, el_id, from_id, style of the nearest element, itself included, that has a recorded style."""
    near = dom.nearest_ancestor(elements, elements.join(styled.select("page_id", "el_id"), ["page_id", "el_id"], "left_semi"), strict=False)
    return near.join(styled.select("page_id", F.col("el_id").alias("anc_id"), "style"), ["page_id", "anc_id"]).select("page_id", "el_id", F.col("anc_id").alias("from_id"), "style")


def pixel_stats(images: DataFrame) -> DataFrame:
    """page_id, el_id, mean (alpha-weighted red, green, blue) and sd (two digits) of RGBA bytes in the column rgba."""

    def run(batches):
        for df in batches:
            means, sds = [], []
            for raw in df.rgba:
                x = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(float)
                a = x[:, 3]
                means.append((x[:, :3] * a[:, None]).sum(axis=0) / a.sum() if a.sum() else np.zeros(3))
                sds.append(np.round(x[:, :3].std(axis=0).mean(), 2) if len(x) else 0.0)
            yield pd.DataFrame({"page_id": df.page_id, "el_id": df.el_id, "mean": [list(m) for m in means], "sd": sds})

    return images.select("page_id", "el_id", "rgba").mapInPandas(run, "page_id long, el_id int, mean array<double>, sd double")


def image_difference(pairs: DataFrame, tolerance: int = 0) -> DataFrame:
    """page_id, same, difference (summed over channels beyond the tolerance), size_differs of two RGBA images (A10)."""

    def run(batches):
        for df in batches:
            rows = []
            for page, one, two in zip(df.page_id, df.one, df.two):
                a, b = (np.frombuffer(x, np.uint8).astype(int) for x in (one, two))
                n = min(len(a), len(b))
                d = np.abs(a[:n] - b[:n])
                total = int(d[d > tolerance].sum())
                rows.append((page, total == 0 and len(a) == len(b), total, len(a) != len(b)))
            yield pd.DataFrame(rows, columns=["page_id", "same", "difference", "size_differs"])

    return pairs.select("page_id", "one", "two").mapInPandas(run, "page_id long, same boolean, difference long, size_differs boolean")
