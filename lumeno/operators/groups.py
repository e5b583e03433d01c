"""Semantic groups on snapshots (G2, G3, G5-G9, G11), by rules over containment, boxes and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeno.functions import text as T
from lumeno.operators import bars as B
from lumeno.operators import boxes, dom, frames, snapshot
from lumeno.plans.shared import once, written

# Fixed values.
SHORT, LONG = 28, 56
HEADER_TEXT, FOOTER_TEXT = 504, 756
KEYWORDS = {"newsletter": ("newsletter", "subscribe", "sign up for"), "search": ("search", "find")}


@once
def _texts(elements: DataFrame) -> DataFrame:
    """page_id, el_id, n: length of all visible text within."""
    return dom.inner_text(elements).select("page_id", "el_id", F.length("text").alias("n"))


@once
def root_element(elements: DataFrame) -> DataFrame:
    """The first element below body whose number of visible children isn't one."""
    kids = elements.groupBy("page_id", F.col("parent_id").alias("el_id")).agg(F.count("*").alias("n_kids"))
    down = dom.inside(elements, elements.where("tag = 'body'"))
    many = down.join(kids, ["page_id", "el_id"], "left").where(F.coalesce("n_kids", F.lit(0)) != 1)
    first = many.groupBy("page_id").agg(F.min_by("el_id", F.struct("depth", "pre")).alias("el_id"))
    return elements.join(first, ["page_id", "el_id"])


def _bars(elements: DataFrame, edge: Column, most_text: int, limit: float) -> DataFrame:
    root = root_element(elements).select("page_id", F.col("l").alias("_l"), F.col("r").alias("_r"), F.col("t").alias("_t"), F.col("b").alias("_b"))
    fit = elements.where(~F.col("tag").isin("html", "body", "head")).join(root, "page_id").join(_texts(elements), ["page_id", "el_id"], "left")
    h = F.col("b") - F.col("t")
    fit = fit.where((F.col("r") - F.col("l") >= 0.9 * (F.col("_r") - F.col("_l"))) & edge & (h <= limit) & (h > 0) & (F.coalesce("n", F.lit(0)) <= most_text))
    return dom.outermost(fit.select(*elements.columns))


@once
def headers(elements: DataFrame, page_height: float = 900) -> DataFrame:
    """Full-width bars at the top with little text."""
    limit = max(255.0, page_height * 0.25)
    return _bars(elements, F.col("t") <= F.col("_t") + 5, HEADER_TEXT, limit)


@once
def footers(elements: DataFrame, page_height: float = 900) -> DataFrame:
    """Full-width bars at the bottom."""
    return _bars(elements, F.col("b") >= F.col("_b") - 5, FOOTER_TEXT, page_height)


@once
def page_bars(elements: DataFrame, pages: DataFrame, page_width: float = 1440, page_height: float = 900) -> DataFrame:
    """page_id, el_id, kind, t, b of headers and footers by the search from the root down (G6), with vertical menus, overlays and gaps."""
    free = dom.outside(snapshot.visible(elements), overlays(elements)).where(~F.col("tag").isin("html", "body"))
    prims = elements.join(snapshot.primitives(elements).select("page_id", "el_id").distinct(), ["page_id", "el_id"], "left_semi")
    return B.search(elements, free, _texts(elements), menus(elements, pages).where("kind = 'menusV'"), prims, page_width, page_height)


def _bar_rows(elements: DataFrame, bars: DataFrame | None) -> DataFrame:
    """Elements that are bars: those given, or full-width ones at the edges."""
    if bars is None:
        return headers(elements).unionByName(footers(elements))
    return elements.join(bars.select("page_id", "el_id").distinct(), ["page_id", "el_id"], "left_semi")


@once
def forms(elements: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Forms that hold no header or footer and are none (G7); bars are those of page_bars, or else full-width ones at the edges."""
    held = dom.above(_bar_rows(dom.paths(elements), bars)).select("page_id", F.col("anc_id").alias("el_id"))
    return elements.where("tag = 'form'").join(held, ["page_id", "el_id"], "left_anti")


@once
def main_body(elements: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """The highest elements that hold primitives and nothing of a header or footer; body where there are neither."""
    bars = _bar_rows(elements, bars)
    inner = dom.closure(elements).join(bars.select("page_id", F.col("el_id").alias("desc_id")), ["page_id", "desc_id"]).select("page_id", F.col("anc_id").alias("el_id"))
    free = dom.outside(elements.join(inner, ["page_id", "el_id"], "left_anti"), bars)
    prim = snapshot.primitives(elements).select("page_id", F.col("el_id").alias("desc_id"))
    holders = dom.closure(elements).join(prim, ["page_id", "desc_id"]).select("page_id", F.col("anc_id").alias("el_id")).distinct()
    found = dom.outermost(free.join(holders, ["page_id", "el_id"], "left_semi"))
    return found.join(bars.select("page_id").distinct(), "page_id", "left_semi").unionByName(elements.where("tag = 'body'").join(bars, "page_id", "left_anti"))


@once
def menus(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, el_id, kind (menusH, menusV), n_items, n_nested of menus (G2): at least three items, 85 % of one font size,
    60 % internal links, equal tag paths, little other text; the outermost ones."""
    elements = dom.paths(elements)
    items = dom.links(elements, pages).join(elements.select("page_id", "el_id", "font_size", "l", "t", "visible", "parent_id", "path"), ["page_id", "el_id"])
    parents = elements.select("page_id", F.col("el_id").alias("parent_id"), F.col("tag").alias("ptag"))
    items = items.join(parents, ["page_id", "parent_id"], "left")
    of = dom.above(items.where("visible"), "external", "font_size", "t", "l", "ptag", "text", strict=True)
    near = F.struct("dist", "ptag")
    stats = of.groupBy("page_id", "anc_id").agg(
        F.count("*").alias("n_items"), F.avg(F.col("external").cast("int")).alias("ext"), F.mode("font_size").alias("size"), F.collect_list("font_size").alias("sizes"),
        F.max("t").alias("t1"), F.min("t").alias("t0"), F.max("l").alias("l1"), F.min("l").alias("l0"), F.count_distinct(near).alias("n_paths"), F.sum(F.length("text")).alias("n_chars"),
    )
    hidden = dom.above(items.where("NOT visible"), strict=True).groupBy("page_id", "anc_id").agg(F.count("*").alias("n_hidden"))
    same = F.size(F.filter("sizes", lambda x: F.abs(x - F.col("size")) <= 0.5)) / F.col("n_items")
    other = _texts(elements).withColumnRenamed("el_id", "anc_id")
    fit = stats.join(hidden, ["page_id", "anc_id"], "left").join(other, ["page_id", "anc_id"], "left").where((F.col("n_items") >= 3) & (F.col("ext") <= 0.4) & (same >= 0.85) & (F.col("n_paths") == 1) & (F.coalesce("n", F.lit(0)) - F.col("n_chars") <= LONG))
    kind = F.when(F.col("t1") - F.col("t0") <= 5, "menusH").when(F.col("l1") - F.col("l0") <= 5, "menusV")
    fit = fit.withColumn("kind", kind).where("kind IS NOT NULL")
    keep = elements.where(~F.col("tag").isin("html", "body")).join(fit.select("page_id", F.col("anc_id").alias("el_id"), "kind", "n_items", F.coalesce("n_hidden", F.lit(0)).alias("n_nested")), ["page_id", "el_id"])
    return dom.outermost(keep).select("page_id", "el_id", "kind", "n_items", "n_nested")


def titles(elements: DataFrame, compat_digits: bool = False) -> DataFrame:
    """Short texts in a font larger than the length-weighted mean of such texts, lifted to their block."""
    t = snapshot.visible_text(elements).withColumn("txt", dom.text_of(F.col("own_text"))).where((F.length("txt") < 125) & (F.length("txt") > 0))
    t = t if compat_digits else t.where(T.digit_share(F.col("txt")) < 0.1)
    mean = t.groupBy("page_id").agg((F.sum(F.length("txt") * F.col("font_size")) / F.sum(F.length("txt"))).alias("_m"))
    big = t.join(mean, "page_id").where(F.col("font_size") > F.col("_m"))
    near = dom.nearest_ancestor(big, elements.where(F.col("tag").isin(*dom.BLOCKS)), strict=False)
    return near.select("page_id", F.col("anc_id").alias("el_id"), F.col("el_id").alias("text_el")).join(big.select("page_id", F.col("el_id").alias("text_el"), F.col("txt").alias("text"), "font_size"), ["page_id", "text_el"])


def logos(elements: DataFrame, pages: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Images within internal links of a header, to the site's root or the shortest path."""
    a = dom.links(elements, pages).where("NOT external")
    a = elements.join(a.select("page_id", "el_id", "href"), ["page_id", "el_id"]).where(~F.contains("href", F.lit("#")))
    a = dom.inside(a, headers(elements) if bars is None else bars.where("kind = 'header'"))
    pics = dom.members(a.withColumn("group_id", F.col("el_id")), elements.where(F.col("tag").isin(*snapshot.MEDIA))).groupBy("page_id", F.col("group_id").alias("el_id")).agg(F.count("*").alias("n"), F.min("el_id").alias("img_id")).where("n = 1")
    depth = F.size(T.path_parts(F.regexp_replace(F.regexp_replace("href", r"[?#].*$", ""), r"^\w+://[^/]*", "")))
    found = a.join(pics, ["page_id", "el_id"]).withColumn("_k", depth)
    least = found.groupBy("page_id").agg(F.min("_k").alias("_k"))
    return found.join(least, ["page_id", "_k"]).select("page_id", F.col("img_id").alias("el_id"), F.col("el_id").alias("link_id"), "href")


def social_buttons(elements: DataFrame, pages: DataFrame, page_width: float = 1440, page_height: float = 900) -> DataFrame:
    """Small external links with an icon and little text."""
    w, h = snapshot.width(), snapshot.height()
    a = elements.join(dom.links(elements, pages).where("external").select("page_id", "el_id", "href"), ["page_id", "el_id"])
    a = a.where((w * h > 10) & (w * h < max(page_width / 5, 100) * max(page_height / 10, 50)))
    icons = snapshot.graphics(elements)
    has = dom.members(a.withColumn("group_id", F.col("el_id")), icons).join(icons.select("page_id", "el_id", "kind"), ["page_id", "el_id"])
    kinds = has.groupBy("page_id", F.col("group_id").alias("el_id")).agg(F.bool_or(F.col("kind").isin("icon", "bg.icon", "ui", "bg.ui")).alias("icon"), F.bool_or(F.col("kind").isin("main", "bg.main")).alias("main")).where("icon AND NOT main")
    return a.join(kinds, ["page_id", "el_id"], "left_semi").join(_texts(elements), ["page_id", "el_id"], "left").where(F.coalesce("n", F.lit(0)) < SHORT).select("page_id", "el_id", "href")


def function_areas(elements: DataFrame) -> DataFrame:
    """page_id, el_id, kind (login, search, newsletter) of small areas with one to three text inputs (G11); keywords count in an area's own text."""
    cond = elements.where(F.col("tag").isin(*dom.CONTROLS))
    areas = elements.where(F.col("tag").isin("form", "div", "section", "fieldset"))
    kind = F.coalesce(F.col("attrs")["type"], F.lit("text"))
    c = cond.select("page_id", "el_id", ((F.col("tag") == "input") & kind.isin("text", "email", "password", "search", "tel")).alias("txt"), (F.col("tag").isin("textarea", "select") | ((F.col("tag") == "input") & kind.isin("range", "color", "file", "radio"))).alias("odd"))
    per = dom.members(areas.withColumn("group_id", F.col("el_id")), cond).join(c, ["page_id", "el_id"]).groupBy("page_id", F.col("group_id").alias("el_id")).agg(F.count("*").alias("n_controls"), F.count_if("txt").alias("n_txt"), F.bool_or("odd").alias("odd"))
    own = elements.select("page_id", "el_id", F.lower(dom.text_of(F.col("own_text"))).alias("low"))
    fit = per.where((F.col("n_controls") >= 2) & (F.col("n_controls") <= 6) & F.col("n_txt").between(1, 3) & ~F.col("odd"))
    fit = fit.join(_texts(elements), ["page_id", "el_id"], "left").where(F.coalesce("n", F.lit(0)) <= LONG).join(own, ["page_id", "el_id"])
    has = lambda k: sum((F.coalesce(F.contains("low", F.lit(w)), F.lit(False)).cast("int") for w in KEYWORDS[k]), F.lit(0)) > 0
    few = F.col("n_controls") < 4
    named = fit.withColumn("kind", F.when(few & has("newsletter"), "newsletter").when(few & has("search"), "search").otherwise("login"))
    return dom.innermost(elements.join(named.select("page_id", "el_id", "kind"), ["page_id", "el_id"])).select("page_id", "el_id", "kind")


def properties(groups: DataFrame, members: DataFrame, rects: DataFrame) -> DataFrame:
    """A row for each group: its root's tag and box, and the box of its primitives (inGrPrimBBox)."""
    inner = members.join(rects.select("page_id", "el_id", *"ltrb"), ["page_id", "el_id"]).groupBy("page_id", "group_id").agg(*[f(k).alias(f"in_{k}") for k, f in (("l", F.min), ("t", F.min), ("r", F.max), ("b", F.max))], F.count("*").alias("n_members"))
    return groups.select("page_id", "group_id", "tag", *"ltrb").join(inner, ["page_id", "group_id"], "left").withColumn("zero_sized", snapshot.width() * snapshot.height() == 0)


@once
def fixed_areas(elements: DataFrame) -> DataFrame:
    """page_id, el_id, location of fixed or sticky bars (G1)."""
    from lumeno.functions import geometry as G

    return elements.where(F.col("position").isin("fixed", "sticky")).withColumn("location", G.sticky_bar({k: F.col(k) for k in "ltrb"})).where("location IS NOT NULL").select("page_id", "el_id", "tag", "location", *"ltrb")


#: How close the edges of layers have to be, as a share of the upper one's size (fixed value).
COINCIDE = 0.05


@once
def overlays(elements: DataFrame, page_height: float = 900, most: float = 0.25) -> DataFrame:
    """Elements that lie over others (G1): fixed ones that are no bars, and positioned ones above the fold that aren't clear and are
    drawn over a primitive that they overlap by more than half its short side. Primitives within them don't count, nor those
    that hold them, nor layers: positioned ones, or in one, with almost the same box. None if over a quarter of the primitives stand in them."""
    pos = snapshot.positioned(elements).join(fixed_areas(elements).select("page_id", "el_id"), ["page_id", "el_id"], "left_anti")
    prim = elements.join(snapshot.primitives(elements).select("page_id", "el_id").distinct(), ["page_id", "el_id"], "left_semi")
    found = dom.outermost(pos.where("position = 'fixed'").unionByName(pos.join(covering(elements, pos.where((F.col("position") != "fixed") & (F.col("t") < page_height)), prim), ["page_id", "el_id"], "left_semi")))
    total = prim.groupBy("page_id").agg(F.count("*").alias("_n"))
    within = dom.inside(prim, found).groupBy("page_id").agg(F.count("*").alias("_k"))
    many = total.join(within, "page_id").where(F.col("_k") > most * F.col("_n")).select("page_id")
    return found.join(many, "page_id", "left_anti")


def clear(elements: DataFrame, candidates: DataFrame) -> DataFrame:
    """page_id, el_id of candidates that show nothing of their own: no main graphic, and no element of a hundredth of their size with a background."""
    area = lambda: snapshot.width() * snapshot.height()
    seen = (F.coalesce(F.get("bg_color", 3), F.lit(1.0)) >= snapshot.MIN_ALPHA) & F.col("bg_color").isNotNull() | (F.coalesce("bg_image", F.lit("none")) != "none")
    filled = dom.above(elements.where(seen), area().alias("_own")).join(candidates.select("page_id", F.col("el_id").alias("anc_id"), area().alias("_all")), ["page_id", "anc_id"]).where("_own > 0.01 * _all")
    pictured = dom.above(snapshot.graphics(elements).where("kind IN ('main', 'bg.main')"), "el_id")
    shown = filled.select("page_id", "anc_id").unionByName(pictured.select("page_id", "anc_id")).distinct().withColumnRenamed("anc_id", "el_id")
    return candidates.select("page_id", "el_id").join(shown, ["page_id", "el_id"], "left_anti")


def covering(elements: DataFrame, candidates: DataFrame, primitives: DataFrame) -> DataFrame:
    """page_id, el_id of candidates drawn over a primitive that neither holds the other, but for layers of the same box."""
    e = elements if "z_index" in elements.columns else elements.withColumn("z_index", F.lit(None).cast("int"))
    order = written(frames.stacking(e), "stacking")
    boxed = lambda df: df.select("page_id", "el_id", *"ltrb").join(order, ["page_id", "el_id"])
    layered = dom.inside(primitives, snapshot.positioned(elements)).select("page_id", "el_id", F.lit(True).alias("layered"))
    under = boxed(primitives).join(layered, ["page_id", "el_id"], "left")
    free = candidates.join(clear(elements, candidates), ["page_id", "el_id"], "left_anti")
    short = F.least(F.col("b_r") - F.col("b_l"), F.col("b_b") - F.col("b_t")) / 2
    met = boxes.tiled(boxed(free), under, short)
    apart = ~F.array_contains("b_path", F.col("a_id")) & ~F.array_contains("a_path", F.col("b_id"))
    near = lambda lo, hi, size: (F.abs(F.col(f"a_{lo}") - F.col(f"b_{lo}")) < COINCIDE * size) & (F.abs(F.col(f"a_{hi}") - F.col(f"b_{hi}")) < COINCIDE * size)
    same = F.coalesce("b_layered", F.lit(False)) & near("l", "r", F.col("a_r") - F.col("a_l")) & near("t", "b", F.col("a_b") - F.col("a_t"))
    return met.where(apart & ~same & frames.drawn_above("a_", "b_")).select("page_id", F.col("a_id").alias("el_id")).distinct()


def rotating_banners(elements: DataFrame, threshold: float = 5) -> DataFrame:
    """page_id, el_id (container), shown_id, hidden_id: a visible main graphic with hidden ones of its tag and size in the lowest element that holds them."""
    g = snapshot.graphics(elements).where("kind in ('main', 'bg.main')").withColumns({"w": snapshot.width(), "h": snapshot.height()})
    side = lambda p, v: g.where(F.col("visible") == v).select("page_id", "tag", F.col("el_id").alias(f"{p}_id"), F.col("w").alias(f"{p}_w"), F.col("h").alias(f"{p}_h"))
    pair = side("shown", True).join(side("hidden", False), ["page_id", "tag"]).where((F.abs(F.col("shown_w") - F.col("hidden_w")) <= threshold) & (F.abs(F.col("shown_h") - F.col("hidden_h")) <= threshold))
    met = dom.common_ancestor(pair.select("page_id", F.col("shown_id").alias("a_id"), F.col("hidden_id").alias("b_id")), elements)
    shown = dom.members(elements.withColumn("group_id", F.col("el_id")), g.where("visible")).groupBy("page_id", "group_id").agg(F.count("*").alias("n")).where("n = 1")
    return met.join(shown, (met["page_id"] == shown["page_id"]) & (met["lca_id"] == shown["group_id"]), "left_semi").select("page_id", F.col("lca_id").alias("el_id"), F.col("a_id").alias("shown_id"), F.col("b_id").alias("hidden_id"))


def main_text(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, el_id, n_chars of text chunks outside forms and menus (G10): the highest elements with at least 75 % such text,
    a full stop, texts of 28 characters on average, and more than 56 in all."""
    elements = dom.paths(elements)
    t = dom.with_text(elements)
    t = dom.outside(dom.outside(t, forms(elements)), elements.join(menus(elements, pages).select("page_id", "el_id"), ["page_id", "el_id"], "left_semi"))
    per = dom.above(t.withColumn("x", dom.text_of(F.col("own_text"))), "x").groupBy("page_id", F.col("anc_id").alias("el_id")).agg(F.sum(F.length("x")).alias("n_chars"), F.avg(F.length("x")).alias("mean"), F.bool_or(F.contains("x", F.lit("."))).alias("dot"))
    good = per.join(_texts(elements), ["page_id", "el_id"]).where((F.col("n_chars") >= 0.75 * F.col("n")) & (F.col("mean") >= SHORT) & F.col("dot") & (F.col("n_chars") > LONG))
    return dom.outermost(elements.where(~F.col("tag").isin("html", "body")).join(good.select("page_id", "el_id", "n_chars"), ["page_id", "el_id"])).select("page_id", "el_id", "n_chars")


def common_font_size(texts: DataFrame) -> DataFrame:
    """For each group the font size that most characters have (A4): rows of page_id, group_id, font_size, n_chars."""
    per = texts.groupBy("page_id", "group_id", "font_size").agg(F.sum("n_chars").alias("n"))
    return per.groupBy("page_id", "group_id").agg(F.max_by("font_size", F.struct("n", "font_size")).alias("font_size"))


def text_white_space(lines: DataFrame) -> DataFrame:
    """White space around text (A7): rows of page_id, group_id, line_height, font_size, width, n_words, n_chars, word_spacing, letter_spacing."""
    gap = F.greatest(F.lit(0.0), (F.col("line_height") - F.col("font_size")) / 2)
    space = 2 * gap * F.col("width") + F.col("line_height") * (F.col("word_spacing") * (F.col("n_words") - 1) + F.col("letter_spacing") * (F.col("n_chars") - 1))
    return lines.groupBy("page_id", "group_id").agg(F.sum(space).alias("space"))


def text_lines(rects: DataFrame, tolerance: float = 5) -> DataFrame:
    """page_id, group_id, n_lines, width (of all lines together): rectangles whose top is within the tolerance of a line's first one make a line (P5)."""
    ordered = F.sort_array(F.collect_list(F.struct("t", "l", "r")))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("sum"))

    def step(a: Column, x: Column) -> Column:
        new = a["top"].isNull() | (x["t"] - a["top"] > tolerance)
        return F.struct(
            (a["n"] + F.when(new, 1).otherwise(0)).alias("n"), F.when(new, x["t"]).otherwise(a["top"]).alias("top"),
            F.when(new, x["l"]).otherwise(F.least(a["lo"], x["l"])).alias("lo"), F.when(new, x["r"]).otherwise(F.greatest(a["hi"], x["r"])).alias("hi"),
            (a["sum"] + F.when(new, a["hi"] - a["lo"]).otherwise(0.0)).alias("sum"),
        )

    made = rects.groupBy("page_id", "group_id").agg(ordered.alias("x")).select("page_id", "group_id", F.aggregate("x", start, step, lambda a: F.struct(a["n"].alias("n_lines"), (a["sum"] + a["hi"] - a["lo"]).alias("width"))).alias("v"))
    return made.select("page_id", "group_id", "v.n_lines", "v.width")
