"""Rectangles of a page: pair joins, distances, overlap, connectedness, enclosure.

All joins have the page as their equality key, so a page's pairs meet in one partition and no global nested loop arises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeno.functions import geometry as G
from lumeno.plans.shared import grouped, starts

BOX = ("l", "t", "r", "b")


def _side(rects: DataFrame, p: str) -> DataFrame:
    return rects.select("page_id", F.col("el_id").alias(f"{p}_id"), *[F.col(k).alias(f"{p}_{k}") for k in BOX])


def pairs(rects: DataFrame, ordered: bool = True) -> DataFrame:
    """All ordered pairs of a page's elements (N4), or each pair once."""
    cond = F.col("a_id") != F.col("b_id") if ordered else F.col("a_id") < F.col("b_id")
    return _side(rects, "a").join(_side(rects, "b"), "page_id").where(cond)


def page_pairs(rects: DataFrame, least: int = 1) -> DataFrame:
    """pairs() with each element paired with itself too, of pages of at least so many elements: a page's rows follow each other, by a_id and b_id.

    A page is gathered in one row and opened again, so no page is joined, sorted or written; all pairs of a page are one task's work.
    """
    page = rects.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("el_id", *BOX))).alias("_els")).where(F.size("_els") >= least)
    both = page.select("page_id", "_els", F.explode("_els").alias("_a")).select("page_id", "_a", F.explode("_els").alias("_b"))
    return both.select("page_id", *[F.col(f"_{k}.{'el_id' if c == 'id' else c}").alias(f"{k}_{c}") for k in "ab" for c in ("id", *BOX)])


def overlapping(one: DataFrame, two: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Pairs whose boxes share more than the tolerance on both axes."""
    return _side(one, "a").join(_side(two, "b"), "page_id").where(G.boxes_overlap("a_", "b_", tolerance))


#: Side of the cells that tiled() deals rectangles to, in pixels.
TILE = 256


def tiled(one: DataFrame, two: DataFrame, tolerance: Column | float = 0.0) -> DataFrame:
    """Pairs of a page's rectangles (a_..., b_...) whose boxes share more than the tolerance on both axes (N3), by cells of the page.

    Rectangles are joined where they have a cell in common, so a page of very many is dealt to many tasks, and far ones never
    meet. A pair counts in the cell of its common corner only, so none is met twice. Needs page_id, l, t, r, b on both sides.
    """
    cell = lambda c: F.floor(F.col(c) / TILE)

    def dealt(df: DataFrame, p: str) -> DataFrame:
        full = df.select("page_id", *[F.col(c).alias(f"{p}_{c}" if c != "el_id" else f"{p}_id") for c in df.columns if c != "page_id"]).where(f"{p}_r > {p}_l AND {p}_b > {p}_t")
        return full.withColumn("_x", F.explode(F.sequence(cell(f"{p}_l"), cell(f"{p}_r")))).withColumn("_y", F.explode(F.sequence(cell(f"{p}_t"), cell(f"{p}_b"))))

    met = dealt(one, "a").join(dealt(two, "b"), ["page_id", "_x", "_y"])
    left, top = F.greatest("a_l", "b_l"), F.greatest("a_t", "b_t")
    least = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    share = (F.least("a_r", "b_r") - left > least) & (F.least("a_b", "b_b") - top > least)
    return met.where((F.floor(left / TILE) == F.col("_x")) & (F.floor(top / TILE) == F.col("_y")) & share).drop("_x", "_y")


def _axes(f, d: str = "") -> tuple:
    c = F.col
    return f(c("a_l"), c("a_r"), c("b_l"), c("b_r")), f(c("a_t"), c("a_b"), c("b_t"), c("b_b"))


def spatial_distance(rects: DataFrame, method: str = "l2") -> DataFrame:
    x, y = _axes(G.gap)
    return pairs(rects).select("page_id", F.lit(f"dist_spat_{method}").alias("metric"), "a_id", "b_id", G.merge(x, y, method).alias("value"))


def spatial_overlap(rects: DataFrame) -> DataFrame:
    """Shares of the first element, on both axes."""
    x, y = _axes(G.overlap)
    return pairs(rects).select("page_id", "a_id", "b_id", x.alias("x"), y.alias("y"))


def connected(method: str = "gauss") -> Column:
    """Of a pair's boxes: overlap on one axis times the faded distance on the other, summed; the larger of both directions."""
    c = F.col

    def one(a: str, b: str):
        ox, oy = G.overlap(c(f"{a}_l"), c(f"{a}_r"), c(f"{b}_l"), c(f"{b}_r")), G.overlap(c(f"{a}_t"), c(f"{a}_b"), c(f"{b}_t"), c(f"{b}_b"))
        dx, dy = G.gap(c(f"{a}_l"), c(f"{a}_r"), c(f"{b}_l"), c(f"{b}_r")), G.gap(c(f"{a}_t"), c(f"{a}_b"), c(f"{b}_t"), c(f"{b}_b"))
        return ox * G.fade(dy, method) + oy * G.fade(dx, method)

    return F.greatest(one("a", "b"), one("b", "a"))


def connectedness(rects: DataFrame, method: str = "gauss") -> DataFrame:
    return pairs(rects).select("page_id", F.lit(f"sim_spatConnect_{method}").alias("metric"), "a_id", "b_id", connected(method).alias("value"))


def encloses(e: str, p: str) -> Column:
    """Whether the box e is an envelope of p, by overlap and size."""
    w, h = F.col(f"{p}r") - F.col(f"{p}l"), F.col(f"{p}b") - F.col(f"{p}t")
    big = (F.col(f"{e}b") - F.col(f"{e}t") >= h / 2) & (F.col(f"{e}r") - F.col(f"{e}l") >= w / 2)
    return big & G.boxes_overlap(p, e, F.least(w / 2, h / 2))


def enclosed(rects: DataFrame, envelopes: DataFrame, contained: DataFrame | None = None) -> DataFrame:
    """page_id, env_id, el_id: elements in each envelope, by containment (page_id, env_id, el_id) and, where that gives
    none, by boxes that overlap by more than half the element's short side, if the envelope has at least half its size (N5)."""
    env = envelopes.select("page_id", F.col("el_id").alias("env_id"), *[F.col(k).alias(f"e_{k}") for k in BOX])
    if contained is not None:
        env = env.join(contained.select("page_id", "env_id").distinct(), ["page_id", "env_id"], "left_anti")
    el = rects.select("page_id", "el_id", *[F.col(k).alias(f"p_{k}") for k in BOX])
    by_box = env.join(el, "page_id").where(encloses("e_", "p_")).select("page_id", "env_id", "el_id")
    return by_box if contained is None else contained.select("page_id", "env_id", "el_id").unionByName(by_box)


def shared_envelopes(inside: DataFrame) -> DataFrame:
    """How many envelopes each ordered pair shares."""
    a, b = inside.withColumnRenamed("el_id", "a_id"), inside.withColumnRenamed("el_id", "b_id")
    made = a.join(b, ["page_id", "env_id"]).where("a_id <> b_id").groupBy("page_id", "a_id", "b_id").agg(F.count("*").cast("double").alias("value"))
    return made.select("page_id", F.lit("mod_bgAndBrd").alias("metric"), "a_id", "b_id", "value")


def bounding_union(rects: DataFrame, *by: str) -> DataFrame:
    return rects.groupBy(*by).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


def equal_coordinates(rects: DataFrame, coord: str, threshold: float = 5) -> DataFrame:
    """For each page how many pairs agree in a coordinate."""
    a, b = (rects.select("page_id", F.col("el_id").alias(f"{p}_id"), F.col(coord).alias(f"{p}_c")) for p in "ab")
    return a.join(b, "page_id").where("a_id < b_id").groupBy("page_id").agg(F.count_if(F.abs(F.col("a_c") - F.col("b_c")) <= threshold).alias("n_equal"), F.count("*").alias("n_pairs"))


def outside_samples(rects: DataFrame, doc_width: float, doc_height: float, per_side: int = 4) -> DataFrame:
    """Points 2 and 5 pixels outside each side of a box, evenly spaced, within the document."""
    made = None
    for axis, lo, hi in (("x", "l", "r"), ("y", "t", "b")):
        size = F.col(hi) - F.col(lo)
        n = F.when(size < per_side * 5, F.greatest(F.lit(1), F.floor(size / 5))).otherwise(F.lit(per_side)).cast("int")
        other = ("t", "b") if axis == "x" else ("l", "r")
        offs = F.array(*[F.col(other[0]) - 2, F.col(other[0]) - 5, F.col(other[1]) + 2, F.col(other[1]) + 5])
        rows = rects.withColumns({"_s": size, "_n": n}).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_o", F.explode(offs))
        along = G.js_round(F.col(lo) - F.col("_s") / F.col("_n") / 2 + F.col("_i") * F.col("_s") / F.col("_n"))
        across = G.js_round(F.col("_o"))
        x, y = (along, across) if axis == "x" else (across, along)
        part = rows.select("page_id", "el_id", x.alias("x"), y.alias("y"))
        made = part if made is None else made.unionByName(part)
    return made.where((F.col("x") >= 0) & (F.col("x") < doc_width) & (F.col("y") >= 0) & (F.col("y") < doc_height))


def area_of_union(boxes: list[tuple[float, float, float, float]]) -> float:
    """Area that rectangles cover together, by a sweep over x."""
    xs = sorted({x for b in boxes for x in (b[0], b[2])})
    total = 0.0
    for x0, x1 in zip(xs, xs[1:]):
        spans, end = sorted((b[1], b[3]) for b in boxes if b[0] <= x0 and b[2] >= x1 and b[3] > b[1]), float("-inf")
        for lo, hi in spans:
            total += (x1 - x0) * max(0.0, hi - max(lo, end))
            end = max(end, hi)
    return total


def flex_space(children: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """Gap area of each flex or grid container (A6): page_id, box_id, space of rows with the container's box c_l.. c_b and a child's l..b.

    On each axis the smallest distance counts that is not negative: half the gap to a child before it that overlaps on the
    other axis by more than `least_overlap` and not on this one, or the distance to the container, of which the larger one of
    both sides is taken. If either axis has half a pixel or more, children grow by these distances, and what they reach within the
    container beyond all children is the space; overlaps count once. Containers of up to four square pixels have none.
    """

    def least(box: np.ndarray, lo: int, hi: int, other: tuple[int, int], c: np.ndarray) -> float:
        edge = np.maximum(box[:, lo] - c[lo], box[:, hi] - c[hi])
        beside = np.minimum(box[:, None, other[1]], box[None, :, other[1]]) - np.maximum(box[:, None, other[0]], box[None, :, other[0]]) > least_overlap
        along = np.minimum(box[:, None, hi], box[None, :, hi]) - np.maximum(box[:, None, lo], box[None, :, lo]) > least_overlap
        np.fill_diagonal(beside, False)
        gap = (box[:, None, lo] - box[None, :, hi]) / 2
        found = np.concatenate([edge, gap[beside & ~along]])
        found = found[found >= 0]
        return float(found.min()) if len(found) else -1.0

    def one(kids: np.ndarray, c: np.ndarray) -> float:
        if (c[2] - c[0]) * (c[3] - c[1]) <= 4:
            return 0.0
        x, y = least(kids, 0, 2, (1, 3), c), least(kids, 1, 3, (0, 2), c)
        if not (min(x, y) >= 0 and max(x, y) >= 0.5):
            return 0.0
        cut = lambda b: np.concatenate([np.maximum(b[:, :2], c[:2]), np.maximum(np.minimum(b[:, 2:], c[2:]), np.maximum(b[:, :2], c[:2]))], axis=1)
        grown, own = cut(kids + [-x, -y, x, y]), cut(kids)
        return area_of_union([tuple(b) for b in np.concatenate([grown, own]).tolist()]) - area_of_union([tuple(b) for b in own.tolist()])

    def run(batches):
        for rows in grouped(batches, *keys):
            at = np.flatnonzero(starts(rows, *keys))
            kids, c = (np.stack([rows[k].to_numpy() for k in cols], axis=1) for cols in (BOX, edges))
            space = [one(kids[i:j], c[i]) for i, j in zip(at, [*at[1:], len(rows)])]
            yield from pa.table({**{k: rows[k].take(at) for k in keys}, "space": pa.array(space, pa.float64())}).to_batches()

    keys, edges = ("page_id", "box_id"), tuple(f"c_{k}" for k in BOX)
    rows = children.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).select(*(F.col(k).cast("long") for k in keys), *(F.col(k).cast("double").alias(k) for k in (*BOX, *edges)))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "page_id long, box_id long, space double")


def inner_outer(rects: DataFrame) -> DataFrame:
    """Inner boxes (less border and padding) as i_l.. i_b and outer ones (with margins) as o_l.. o_b (F4): paddings, borders and margins
    are arrays of top, right, bottom, left. An inner box is never turned inside out."""
    at = lambda name, k: F.coalesce(F.get(name, k), F.lit(0.0))
    inset = [at("paddings", k) + at("borders", k) for k in range(4)]
    i = {"l": F.col("l") + inset[3], "t": F.col("t") + inset[0]}
    inner = {f"i_{k}": v for k, v in i.items()} | {"i_r": F.greatest(i["l"], F.col("r") - inset[1]), "i_b": F.greatest(i["t"], F.col("b") - inset[2])}
    outer = {"o_l": F.col("l") - at("margins", 3), "o_t": F.col("t") - at("margins", 0), "o_r": F.col("r") + at("margins", 1), "o_b": F.col("b") + at("margins", 2)}
    return rects.withColumns(inner | outer)


def padding_margin_space(boxes: DataFrame, *by: str) -> DataFrame:
    """The area between outer and inner boxes, summed by group (the box part of A5); negative ones count as none."""
    area = lambda p: (F.col(f"{p}_r") - F.col(f"{p}_l")) * (F.col(f"{p}_b") - F.col(f"{p}_t"))
    return boxes.groupBy(*by).agg(F.sum(F.greatest(area("o") - area("i"), F.lit(0.0))).alias("space"))


def useful_white_space(box_part: DataFrame, flex: DataFrame, text: DataFrame) -> DataFrame:
    """page_id, group_id, space: paddings and margins, gaps of flex containers and space around text together (A5); each has page_id, group_id, space."""
    return box_part.unionByName(flex).unionByName(text).groupBy("page_id", "group_id").agg(F.sum("space").alias("space"))
