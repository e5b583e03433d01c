"""Boxes as columns left, top, right, bottom (l, t, r, b), and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the element tests, in pixels.
UI_SIDE, UI_SIDE_REAL = 40, 20
ICON_SIDE, ICON_SIDE_REAL = 48, 32
IFRAME_AREA = 150 * 30
FADE_SIGMA, FADE_END = 14, 44
LINEAR_END, BINARY_END = 45, 15


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def gap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Signed distance of two intervals: from the end of the one that begins first to the begin of the other."""
    return F.when(lo1 < lo2, lo2 - hi1).otherwise(lo1 - hi2)


def distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.lit(0.0), gap(lo1, hi1, lo2, hi2))


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """The shared length as a share of the first interval."""
    shared = F.least(hi1, hi2) - F.greatest(lo1, lo2)
    return F.when(shared <= 0, 0.0).otherwise(shared / F.when(hi1 > lo1, hi1 - lo1))


def merge(x: Column, y: Column, method: str = "l2", threshold: float = 5) -> Column:
    """One distance from two: max, l1, l2 or bin."""
    x, y = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    made = {"max": F.greatest(x, y), "l1": x + y, "l2": F.hypot(x, y), "bin": F.when((x < threshold) & (y < threshold), 0.0).otherwise(1.0)}
    return made[method]


def fade(d: Column, method: str = "gauss") -> Column:
    """1 at no distance, falling to 0: gauss, lin or bin."""
    if method == "gauss":
        i = js_round(d)
        return F.when(d < 0, 1.0).when(d > FADE_END, 0.0).otherwise(F.exp(-(i * i) / (2.0 * FADE_SIGMA * FADE_SIGMA)))
    if method == "lin":
        return F.when(d < 0, 1.0).when(d > LINEAR_END - 1, 0.0).otherwise((LINEAR_END - 1 - d) / (LINEAR_END - 1))
    if method == "bin":
        return F.when(d < BINARY_END, 1.0).otherwise(0.0)
    raise ValueError(method)


def boxes_overlap(a: str, b: str, tolerance: Column | float = 0.0) -> Column:
    """Whether two boxes (column prefixes a and b) share more than the tolerance on both axes."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    c = lambda p, k: F.col(f"{p}{k}")
    return (F.least(c(a, "r"), c(b, "r")) - F.greatest(c(a, "l"), c(b, "l")) > t) & (F.least(c(a, "b"), c(b, "b")) - F.greatest(c(a, "t"), c(b, "t")) > t)


def clip(box: dict[str, Column], parent: dict[str, Column], x: bool = True, y: bool = True) -> dict[str, Column]:
    """The box within its parent, never of negative size."""
    lo, hi = dict(box), dict(box)
    for a, b, on in (("l", "r", x), ("t", "b", y)):
        lo[a] = F.greatest(box[a], parent[a]) if on else box[a]
        hi[b] = F.greatest(F.least(box[b], parent[b]) if on else box[b], lo[a])
    return {"l": lo["l"], "t": lo["t"], "r": hi["r"], "b": hi["b"]}


def is_ui(w: Column, h: Column, real: bool = False) -> Column:
    """A narrow, long graphic."""
    return (F.least(w, h) <= (UI_SIDE_REAL if real else UI_SIDE)) & (F.greatest(w, h) >= 1.5 * F.least(w, h))


def is_icon(w: Column, h: Column, real: bool = False) -> Column:
    """A small, roughly square graphic."""
    return (F.greatest(w, h) <= (ICON_SIDE_REAL if real else ICON_SIDE)) & (F.greatest(w, h) <= 1.5 * F.least(w, h))


def iframe_kind(w: Column, h: Column) -> Column:
    return F.when(w * h <= IFRAME_AREA, "primitive").otherwise("standalone")


def is_widget(frame_area: Column, page_area: Column) -> Column:
    return page_area * 0.8 > frame_area


def sticky_bar(box: dict[str, Column], width: float = 1440, height: float = 900) -> Column:
    """Where a fixed bar sticks (top, bottom, left, right), null if it is no bar."""
    w, h = box["r"] - box["l"], box["b"] - box["t"]
    near = lambda x, at: (x < at + 5) & (x > at - 5)
    full_w, full_h = width * 0.9, height * 0.9
    large = ((w > full_w) & (h > full_h / 2)) | ((w > full_w / 2) & (h > full_h))
    return (
        F.when(large, None)
        .when((w > full_w) & near(box["t"], 0), "top")
        .when((w > full_w) & near(box["b"], height), "bottom")
        .when((h > full_h) & near(box["l"], 0), "left")
        .when((h > full_h) & near(box["r"], width), "right")
    )


def same_box(a: str, b: str, threshold: float) -> Column:
    made = F.lit(True)
    for k in "ltrb":
        made = made & (F.abs(F.col(f"{a}{k}") - F.col(f"{b}{k}")) <= threshold)
    return made


def sane_width(scroll: Column, client: Column) -> Column:
    return F.when(scroll < 1.5 * client, scroll).otherwise(client)
