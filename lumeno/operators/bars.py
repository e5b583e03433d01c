"""Headers and footers by a search from the root down (G6), and boxes that hold floated content.

The tree that is searched has visible elements only: an element's children are its visible child elements and, of each
child that can't be seen, the visible elements below it that are nearest. Its root is the first element from body on that doesn't have
exactly one child. From there a branch is followed as long as its elements are no bars themselves but may hold one.

An element is reached if all elements between it and the root are followed. That is a condition on the elements of its
path, so the search is one aggregation over exploded paths, at any depth, and a page of very many elements is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumeno.operators import boxes, dom
from lumeno.plans.shared import written

# Fixed values.
LEAST_LIMIT, LIMIT_SHARE, FOOTER_SHARE, FULL_WIDTH = 255.0, 0.25, 0.2, 0.9
MOST_TEXT = {"header": 504, "footer": 756}


def float_proof(elements: DataFrame) -> DataFrame:
    """Elements without height reach as far as what they hold, as if they contained its floats."""
    # Tasks sum their pages' paths first, so that less is shuffled than paths of what stands in elements without height.
    made = dom.above(elements.where("b > t"), "t", "b", strict=True).groupBy("page_id", F.col("anc_id").alias("el_id")).agg(F.min("t").alias("_t"), F.max("b").alias("_b"))
    reach = lambda c: F.when(F.col("b") == F.col("t"), F.coalesce(f"_{c}", c)).otherwise(F.col(c))
    return elements.join(made, ["page_id", "el_id"], "left").withColumns({c: reach(c) for c in "tb"}).drop("_t", "_b")


def _nodes(elements: DataFrame, seen: DataFrame) -> DataFrame:
    """The elements in seen and body; a column _seen says which are in seen already."""
    if "_seen" in elements.columns:
        return elements.where("_seen OR tag = 'body'")
    named = seen.select("page_id", "el_id").unionByName(elements.where("tag = 'body'").select("page_id", "el_id")).distinct()
    return elements.join(named, ["page_id", "el_id"], "left_semi")


def visible_children(elements: DataFrame, seen: DataFrame) -> DataFrame:
    """page_id, el_id, up_id: the tree of body and the elements in seen; those that are behind nearer ones have no row."""
    nodes = _nodes(dom.paths(elements), seen)
    up = nodes.where("tag <> 'body'").select("page_id", "el_id", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_k", "anc_id"))
    # via: the child of anc_id that holds the element, itself or one that can't be seen.
    up = up.select("page_id", "el_id", "anc_id", F.get("path", F.col("_k") + 1).alias("via"), (F.size("path") - F.col("_k") - 1).alias("dist"))
    near = up.join(nodes.select("page_id", F.col("el_id").alias("anc_id")), ["page_id", "anc_id"]).groupBy("page_id", "el_id").agg(F.min(F.struct("dist", "anc_id", "via")).alias("x")).select("page_id", "el_id", "x.*")
    least = F.min("dist").over(Window.partitionBy("page_id", "via"))
    return near.withColumn("_least", least).where("dist = _least").select("page_id", "el_id", F.col("anc_id").alias("up_id"))


def visible_nodes(elements: DataFrame, seen: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id, anc_id, joined, kids of body and each element in seen: whether the tree leads from body to it at all, and how many children it has."""
    up = edges.select("page_id", "el_id", F.lit(True).alias("joined")).unionByName(elements.where("tag = 'body'").select("page_id", "el_id", F.lit(True).alias("joined")))
    kids = edges.groupBy("page_id", F.col("up_id").alias("el_id")).agg(F.count("*").alias("kids"))
    named = _nodes(elements, seen).select("page_id", "el_id").join(up, ["page_id", "el_id"], "left").join(kids, ["page_id", "el_id"], "left")
    return named.select("page_id", F.col("el_id").alias("anc_id"), F.coalesce("joined", F.lit(False)).alias("joined"), F.coalesce("kids", F.lit(0)).alias("kids"))


def visible_root(elements: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, root_id: the first element from body on whose number of children isn't one.

    Only body and the elements that are their parent's one child can be it, so the others' paths aren't exploded.
    """
    lonely = edges.join(nodes.where("kids = 1").select("page_id", F.col("anc_id").alias("up_id")), ["page_id", "up_id"], "left_semi").select("page_id", "el_id")
    some = lonely.unionByName(elements.where("tag = 'body'").select("page_id", "el_id")).distinct()
    chains = dom.above(dom.paths(elements).select("page_id", "el_id", "path").join(some, ["page_id", "el_id"], "left_semi"), "el_id").join(nodes, ["page_id", "anc_id"])
    only = F.col("joined") & ((F.col("dist") == 0) | (F.col("kids") == 1))
    on = chains.groupBy("page_id", "el_id").agg(F.bool_and(only).alias("only"), F.count("*").alias("n")).where("only")
    return on.groupBy("page_id").agg(F.max_by("el_id", "n").alias("root_id"))


def limits(page_width: float, page_height: float) -> tuple[float, Column]:
    """How low a header may end, and how high a footer may begin."""
    low = max(LEAST_LIMIT, min(page_width, page_height) * LIMIT_SHARE)
    return low, F.greatest(F.col("doc_height") * FOOTER_SHARE, F.lit(low))


def search(elements: DataFrame, seen: DataFrame, texts: DataFrame, menus: DataFrame, primitives: DataFrame, page_width: float = 1440, page_height: float = 900) -> DataFrame:
    """page_id, el_id, kind (header, footer), t, b of a page's bars.

    seen are the elements that can be seen and stand in no overlay; texts (page_id, el_id, n) have the length of the visible text within;
    a header holds none of menus, the vertical ones. Bars are as wide as the root but for a tenth, with little text, and end or
    begin within twice the limit of their edge. Of these count those within the limit itself, or else the one that is
    nearest to the edge; in the end only those that no primitive (page_id, el_id, l, t, r, b) outside all of them is beyond.
    """
    e = float_proof(dom.paths(elements))
    e = boxes.inner_outer(e.withColumns({c: F.lit(None).cast("array<double>") for c in ("paddings", "borders", "margins") if c not in e.columns}))
    e = e.join(seen.select("page_id", "el_id", F.lit(True).alias("_seen")).distinct(), ["page_id", "el_id"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    e = written(e.select("page_id", "el_id", "_seen", "tag", "pre", "path", *"ltrb", *(f"{p}_{k}" for p in "io" for k in "ltrb"), "doc_height"), "boxed")
    edges = written(visible_children(e, seen), "visible")
    nodes = written(visible_nodes(e, seen, edges), "nodes")
    top = visible_root(e, edges, nodes)
    low, room = limits(page_width, page_height)
    wide = top.join(e.select("page_id", F.col("el_id").alias("root_id"), (FULL_WIDTH * (F.col("r") - F.col("l"))).alias("full"), F.size("path").alias("root_depth")), ["page_id", "root_id"])
    holders = dom.above(e.join(menus.select("page_id", "el_id").distinct(), ["page_id", "el_id"], "left_semi")).select("page_id", F.col("anc_id").alias("el_id"), F.lit(True).alias("menu")).distinct()
    near = F.col("doc_height") - 2 * room
    edges_of = {"low_b": F.col("i_b") <= 2 * low, "low_t": F.col("i_t") <= 2 * low, "high_t": F.col("i_t") >= near, "high_b": F.col("i_b") >= near}
    rows = e.where("_seen").select("page_id", "el_id", "path", (F.col("o_r") - F.col("o_l")).alias("width"), *[v.alias(k) for k, v in edges_of.items()])
    rows = rows.join(texts.select("page_id", "el_id", "n"), ["page_id", "el_id"], "left").join(holders, ["page_id", "el_id"], "left").join(nodes.select("page_id", F.col("anc_id").alias("el_id"), "joined"), ["page_id", "el_id"])
    spans, few = F.col("width") >= F.col("full"), lambda kind: F.coalesce("n", F.lit(0)) <= MOST_TEXT[kind]
    flags = {
        "is_header": spans & F.col("low_b") & few("header") & F.col("menu").isNull(), "in_header": spans & F.col("low_t"),
        "is_footer": spans & F.col("high_t") & few("footer"), "in_footer": spans & F.col("high_b"),
    }
    rows = rows.join(wide, "page_id")
    facts = written(rows.select("page_id", F.col("el_id").alias("anc_id"), "path", "joined", *[v.alias(k) for k, v in flags.items()]).where(F.array_contains("path", F.col("root_id")) & (F.size("path") > F.col("root_depth"))), "facts")
    # What is a bar itself brings its path.
    on = dom.above(facts.where("is_header OR is_footer").withColumnRenamed("anc_id", "el_id"), "el_id").join(facts.drop("path"), ["page_id", "anc_id"])
    follow = lambda kind: F.bool_and(F.col("joined") & F.when(F.col("dist") == 0, F.col(f"is_{kind}")).otherwise(F.col(f"in_{kind}") & ~F.col(f"is_{kind}"))).alias(kind)
    found = on.groupBy("page_id", "el_id").agg(follow("header"), follow("footer"))
    kinds = F.array_compact(F.array(*[F.when(F.col(k), k) for k in MOST_TEXT]))
    found = found.select("page_id", "el_id", F.explode(kinds).alias("kind")).join(e.select("page_id", "el_id", "pre", "t", "b", "doc_height"), ["page_id", "el_id"])
    inside = F.when(F.col("kind") == "header", F.col("b") <= low).otherwise(F.col("t") >= F.col("doc_height") - room)
    whole = Window.partitionBy("page_id", "kind")
    edge = F.when(F.col("kind") == "header", F.col("t")).otherwise(-F.col("b"))
    ranked = found.withColumns({"ok": inside, "any": F.max(inside).over(whole), "rank": F.row_number().over(whole.orderBy(edge, "pre"))})
    bars = written(ranked.where(F.col("ok") | (~F.col("any") & (F.col("rank") == 1))), "bars")
    return _without_gaps(bars, e, primitives).select("page_id", "el_id", "kind", "t", "b")


def _without_gaps(bars: DataFrame, elements: DataFrame, primitives: DataFrame) -> DataFrame:
    """Bars that no primitive is beyond which stands in none of the page's bars of their kind and holds none of them."""
    keyed = bars.select("page_id", "kind", F.col("el_id").alias("bar_id"))
    p = elements.select("page_id", "el_id", "path").join(primitives.select("page_id", "el_id", F.col("t").alias("p_t"), F.col("b").alias("p_b")), ["page_id", "el_id"])
    held = dom.above(p, "el_id").select("page_id", "el_id", F.col("anc_id").alias("bar_id")).join(keyed, ["page_id", "bar_id"]).select("page_id", "el_id", "kind")
    over = dom.above(elements.join(bars.select("page_id", "el_id", "kind"), ["page_id", "el_id"]), "kind").select("page_id", F.col("anc_id").alias("el_id"), "kind")
    known = held.unionByName(over).distinct()
    alone = p.select("page_id", "el_id", "p_t", "p_b").join(bars.select("page_id", "kind").distinct(), "page_id").join(known, ["page_id", "el_id", "kind"], "left_anti")
    ends = alone.groupBy("page_id", "kind").agg(F.min("p_t").alias("first"), F.max("p_b").alias("last"))
    clear = F.when(F.col("kind") == "header", F.coalesce(F.col("first") >= F.col("t"), F.lit(True))).otherwise(F.coalesce(F.col("last") <= F.col("b"), F.lit(True)))
    return bars.join(ends, ["page_id", "kind"], "left").where(clear)
