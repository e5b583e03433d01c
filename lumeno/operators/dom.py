"""Element trees: containment by interval, ancestors, distances.

An element contains another one of its page if it is on the other's path, the ids from the root down to the element, which the
parser writes. So containment is a join on page and id of the elements' exploded paths: work is elements by depth, and a page
of very many elements is dealt to many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumeno.plans.shared import broadcast_measured, grouped, starts

# Tag sets.
CONTROLS = ("button", "input", "option", "select", "details", "textarea", "audio", "portal")
DECORATIVE = ("kbd", "hr", "meter", "progress")
TEXT_INPUTS = ("datetime-local", "button", "reset", "text", "date", "email", "month", "number", "search", "tel", "time", "url", "week", "datetime", "submit")
BLOCKS = ("address", "article", "aside", "blockquote", "details", "dialog", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")


def paths(elements: DataFrame) -> DataFrame:
    """elements with their paths, made from the parents where they are missing; a parent that isn't there is the first of a path.

    Tasks read whole pages one after the other, sorted, as many at a time as a batch has, and hold one page that isn't complete at most.
    """
    broadcast_measured(elements.sparkSession)
    if "path" in elements.columns:
        return elements
    rows = elements.where("page_id IS NOT NULL AND el_id IS NOT NULL").select("page_id", F.col("el_id").cast("int").alias("el_id"), *[c for c in elements.columns if c not in ("page_id", "el_id")])
    schema = T.StructType([*rows.schema.fields, T.StructField("path", T.ArrayType(T.IntegerType()))])
    return rows.repartition("page_id").sortWithinPartitions("page_id", "el_id").mapInArrow(lambda batches: (b for t in grouped(batches, "page_id") for b in _with_paths(t).to_batches()), schema)


def _with_paths(rows: pa.Table) -> pa.Table:
    """Whole pages, sorted by page and element, with the column path: all elements go up one step at a time."""
    page = starts(rows, "page_id").cumsum() << 32
    ids, parent = (rows[c].combine_chunks().cast(pa.int64()) for c in ("el_id", "parent_id"))
    has, ids, parent = parent.is_valid().to_numpy(zero_copy_only=False), ids.to_numpy(), parent.fill_null(0).to_numpy()
    own, wanted = page + ids, page + parent
    # Of equal ids the last one counts.
    up = np.maximum(np.searchsorted(own, wanted, side="right") - 1, 0)
    found = has & (own[up] == wanted)
    steps, size = [], np.ones(len(ids), np.int64)
    who = at = np.arange(len(ids))
    while len(who):
        steps.append((who, ids[at]))
        if len(steps) > len(ids):
            raise ValueError("an element of a page is its own ancestor")
        lost = has[at] & ~found[at]
        size[who[lost]] += 1
        top = who[lost], parent[at[lost]]
        who, at = who[found[at]], up[at[found[at]]]
        size[who] += 1
        steps[-1] = (*steps[-1], *top)
    ends = size.cumsum()
    flat = np.empty(ends[-1] if len(ends) else 0, np.int32)
    for k, (one, value, orphan, above_it) in enumerate(steps):
        flat[ends[one] - 1 - k] = value
        flat[ends[orphan] - 2 - k] = above_it
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return rows.append_column("path", pa.ListArray.from_arrays(offsets, pa.array(flat)))


def above(elements: DataFrame, *cols: str | Column, strict: bool = False) -> DataFrame:
    """page_id, anc_id, dist and cols for each element and each of its ancestors, itself included unless strict."""
    e = paths(elements)
    rows = e.select("page_id", *cols, F.size("path").alias("_n"), F.posexplode("path").alias("_k", "anc_id")).withColumn("dist", F.col("_n") - F.col("_k") - 1)
    return (rows.where("dist > 0") if strict else rows).drop("_n", "_k")


def closure(elements: DataFrame, inclusive: bool = True) -> DataFrame:
    """page_id, anc_id, desc_id, dist of every element and its ancestors."""
    return above(elements, "el_id", strict=not inclusive).select("page_id", "anc_id", F.col("el_id").alias("desc_id"), "dist")


def _ids(elements: DataFrame, name: str) -> DataFrame:
    return elements.select("page_id", F.col("el_id").alias(name)).distinct()


def _within(elements: DataFrame, containers: DataFrame, how: str, strict: bool) -> DataFrame:
    hit = above(elements, "el_id", strict=strict).join(_ids(containers, "anc_id"), ["page_id", "anc_id"], "left_semi").select("page_id", "el_id").distinct()
    return elements.join(hit, ["page_id", "el_id"], how)


def inside(elements: DataFrame, containers: DataFrame, strict: bool = False) -> DataFrame:
    """Elements within any container (N1 as a semi join)."""
    return _within(elements, containers, "left_semi", strict)


def outside(elements: DataFrame, containers: DataFrame, strict: bool = False) -> DataFrame:
    """Elements within no container (N1 as an anti join, F30)."""
    return _within(elements, containers, "left_anti", strict)


def outermost(elements: DataFrame) -> DataFrame:
    """Without elements that stand in another one of the set."""
    return outside(elements.dropDuplicates(["page_id", "el_id"]), elements, strict=True)


def innermost(elements: DataFrame) -> DataFrame:
    """Without elements that contain another one of the set."""
    holders = above(elements, strict=True).select("page_id", F.col("anc_id").alias("el_id")).distinct()
    return elements.dropDuplicates(["page_id", "el_id"]).join(holders, ["page_id", "el_id"], "left_anti")


def members(groups: DataFrame, elements: DataFrame) -> DataFrame:
    """page_id, group_id, el_id: the elements each group's root (el_id) contains, itself included."""
    roots = groups.select("page_id", "group_id", F.col("el_id").alias("anc_id"))
    return above(elements, "el_id").join(roots, ["page_id", "anc_id"]).select("page_id", "group_id", "el_id")


def by_tag(elements: DataFrame, tags: tuple[str, ...], inverse: bool = False, ancestors: DataFrame | None = None) -> DataFrame:
    """Elements with one of the tags, or, with ancestors, in an element that has one."""
    if ancestors is None:
        hit = F.col("tag").isin(*tags)
        return elements.where(~hit if inverse else hit)
    return (outside if inverse else inside)(elements, ancestors.where(F.col("tag").isin(*tags)))


def nearest_ancestor(elements: DataFrame, candidates: DataFrame, strict: bool = True) -> DataFrame:
    """page_id, el_id, anc_id, dist: the closest candidate that contains an element (N9); elements without one are left out."""
    near = above(elements, "el_id", strict=strict).join(_ids(candidates, "anc_id"), ["page_id", "anc_id"])
    return near.groupBy("page_id", "el_id").agg(F.min_by("anc_id", "dist").alias("anc_id"), F.min("dist").alias("dist"))


def _met(path_a: str, path_b: str) -> list[Column]:
    """lca_id, up_a, up_b of two paths: what they have in common is where both begin."""
    both = F.array_intersect(path_a, path_b)
    return [F.element_at(both, -1).alias("lca_id"), (F.size(path_a) - F.size(both)).alias("up_a"), (F.size(path_b) - F.size(both)).alias("up_b")]


def common_ancestor(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The deepest element that contains both of a pair, and the steps between them through it."""
    e = paths(elements)
    a, b = (e.select("page_id", F.col("el_id").alias(f"{k}_id"), F.col("path").alias(f"_{k}")) for k in "ab")
    met = pairs.join(a, ["page_id", "a_id"]).join(b, ["page_id", "b_id"]).where(F.arrays_overlap("_a", "_b"))
    return met.select("page_id", "a_id", "b_id", *_met("_a", "_b"))


def html_distance(elements: DataFrame, method: str = "sum") -> DataFrame:
    """Steps from each element to the lowest common ancestor: sum, max or min of both (C1), for ordered pairs of the given elements' page."""
    e = paths(elements)
    a, b = (e.select("page_id", F.col("el_id").alias(f"{k}_id"), F.col("path").alias(f"_{k}")) for k in "ab")
    met = a.join(b, "page_id").where((F.col("a_id") != F.col("b_id")) & F.arrays_overlap("_a", "_b")).select("page_id", "a_id", "b_id", *_met("_a", "_b"))
    value = {"sum": F.col("up_a") + F.col("up_b"), "max": F.greatest("up_a", "up_b"), "min": F.least("up_a", "up_b")}[method].cast("double")
    return met.select("page_id", F.lit(f"dist_html_{method}").alias("metric"), "a_id", "b_id", value.alias("value"))


def text_of(parts: Column) -> Column:
    from lumeno.functions.text import cut_invisible, own_text

    return cut_invisible(own_text(parts))


def with_text(elements: DataFrame) -> DataFrame:
    """Elements with own text that isn't blank, of those that aren't controls."""
    from lumeno.functions.text import clean_string, own_text

    return elements.where(~F.col("tag").isin("textarea", "button", "option", "script", "style") & (F.length(clean_string(own_text(F.col("own_text")))) > 0))


def text_controls(elements: DataFrame) -> DataFrame:
    """Controls without child elements that show a value or a placeholder, with that text."""
    a = lambda k: F.col("attrs")[k]
    kind = F.coalesce(a("type"), F.lit("text"))
    shown = F.coalesce(F.when(F.length(a("value")) > 0, a("value")), F.when(F.length(a("placeholder")) > 0, a("placeholder")), F.when(kind == "submit", "Submit").when(kind == "reset", "Reset"), F.when(F.col("tag") != "input", text_of(F.col("own_text"))))
    parents = elements.where(F.col("parent_id").isNotNull()).select("page_id", F.col("parent_id").alias("el_id"))
    leaf = elements.where(F.col("tag").isin("textarea", "button", "option") | ((F.col("tag") == "input") & kind.isin(*TEXT_INPUTS))).join(parents, ["page_id", "el_id"], "left_anti")
    return leaf.withColumn("shown", shown).where(F.length("shown") > 0)


def native_controls(elements: DataFrame, name: str = "real") -> DataFrame:
    """act, decor or both as real."""
    tags = {"act": CONTROLS, "decor": DECORATIVE, "real": CONTROLS + DECORATIVE}[name]
    return elements.where(F.col("tag").isin(*tags))


def inner_text(elements: DataFrame) -> DataFrame:
    """page_id, el_id, text: all text within, in document order."""
    e = with_text(elements).withColumn("t", text_of(F.col("own_text")))
    made = above(e, F.col("pre").alias("ord"), "t").groupBy("page_id", F.col("anc_id").alias("el_id"))
    return made.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "").alias("text"))


def paragraphs(elements: DataFrame) -> DataFrame:
    """page_id, el_id, n_texts, text: texts under their nearest block (P1, P4); inner blocks have their own."""
    texts = with_text(elements)
    near = nearest_ancestor(texts, elements.where(F.col("tag").isin(*BLOCKS)), strict=False)
    rows = near.join(texts.select("page_id", "el_id", F.col("pre").alias("ord"), text_of(F.col("own_text")).alias("t")), ["page_id", "el_id"])
    return rows.groupBy("page_id", F.col("anc_id").alias("el_id")).agg(F.count("*").alias("n_texts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "").alias("text"))


def links(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, el_id, href (absolute), target, text, external of all <a> with href."""
    from lumeno.functions.text import external, url_host

    a = elements.where((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()).join(pages.select("page_id", "url"), "page_id")
    href, root = F.col("attrs")["href"], F.regexp_extract("url", r"^\w+://[^/?#]+", 0)
    full = (
        F.when(F.regexp_like(href, F.lit(r"^[A-Za-z][\w+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.substring_index("url", "//", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.substring_index("url", "#", 1), href))
        .otherwise(F.concat(F.regexp_extract(F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("")), r"^(\w+://[^/]+/(?:.*/)?|\w+://[^/]+)", 1), F.when(F.regexp_like("url", F.lit(r"^\w+://[^/?#]+/")), "").otherwise("/"), href))
    )
    made = a.withColumn("href", full)
    return made.select("page_id", "el_id", "href", F.coalesce(F.col("attrs")["target"], F.lit("")).alias("target"), text_of(F.col("own_text")).alias("text"), external(F.col("href"), url_host(F.col("url"))).alias("external"))


def icons(elements: DataFrame) -> DataFrame:
    """page_id, href, tier of each page's icon links, or else /favicon.ico (S16); nothing is fetched."""
    found = elements.where((F.col("tag") == "link") & F.contains(F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), F.lit("icon")) & F.col("attrs")["href"].isNotNull()).select("page_id", F.col("attrs")["href"].alias("href"), F.lit(1).alias("tier"))
    rest = elements.select("page_id").distinct().join(found, "page_id", "left_anti").select("page_id", F.lit("/favicon.ico").alias("href"), F.lit(2).alias("tier"))
    return found.unionByName(rest)


def common_host(link_rows: DataFrame) -> DataFrame:
    """The most frequent host of a page's links; of equal ones the first seen (A3)."""
    from lumeno.functions.text import url_host

    h = link_rows.where(F.startswith("href", F.lit("http"))).withColumn("host", url_host(F.col("href"))).groupBy("page_id", "host").agg(F.count("*").alias("n"), F.min("el_id").alias("at"))
    return h.groupBy("page_id").agg(F.max_by("host", F.struct("n", -F.col("at"))).alias("host"))
