"""Elements that selectors of their page's style sheets fit.

Every compound of every selector is joined with the elements of its page by its rarest key, an id, a class or a tag, and what
else it asks is tested in generated code. Sheets that pages have in common are compiled once, and if the compounds of all sheets
are few they are broadcast to the elements. Then the combinators are followed from left to right: an element fits the first k
compounds if it fits the k-th and one that fits those before stands where the combinator says, which is a semi join with its
ancestors, its parent or its siblings. So there are as many steps as the longest selector has compounds, and no step is a loop
over pages, selectors or elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumeno.operators import dom
from lumeno.plans.shared import written
from lumeno.sources import css

KEYS = ("page_id", "sheet", "sel_id")
FLAGS = ("hover", "by_order", "by_attr")
#: Compounds of all sheets together that are broadcast at most.
FEW_PARTS = 100_000


def positioned(elements: DataFrame, empty: bool = True) -> DataFrame:
    """page_id, el_id, parent_id, prev_id, pre, path and, in e, what compounds test: tag, id, classes, attributes and the positions among siblings.

    Without empty nothing counts as an empty element, and no element is joined with its children. A column `uses` is kept.
    """
    among, of_type = Window.partitionBy("page_id", "parent_id"), Window.partitionBy("page_id", "parent_id", "tag")
    at, typed = F.row_number().over(among.orderBy("pre")), F.row_number().over(of_type.orderBy("pre"))
    e = dom.paths(elements).withColumns({"prev_id": F.lag("el_id").over(among.orderBy("pre")), "_at": at, "_n": F.count("*").over(among), "_of": typed, "_nt": F.count("*").over(of_type)})
    if empty:
        kids = elements.where("parent_id IS NOT NULL").select("page_id", F.col("parent_id").alias("el_id"), F.lit(True).alias("_kids")).distinct()
        e = e.join(kids, ["page_id", "el_id"], "left")
    attr = lambda k: F.coalesce(F.col("attrs")[k], F.lit(""))
    words = F.filter(F.split(attr("class"), r"\s+"), lambda x: x != "")
    blank = F.col("_kids").isNull() & (F.coalesce(F.size("own_text"), F.lit(0)) <= 0) if empty else F.lit(False)
    counters = [F.col("_at").alias("at"), (F.col("_n") - F.col("_at") + 1).alias("from_end"), F.col("_of").alias("of_type"), (F.col("_nt") - F.col("_of") + 1).alias("of_type_from_end"), F.col("parent_id").isNull().cast("int").alias("root"), blank.cast("int").alias("empty")]
    facts = F.struct("tag", attr("id").alias("id"), words.alias("classes"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"), *counters)
    return e.select("page_id", "el_id", "parent_id", "prev_id", "pre", "path", facts.alias("e"), *[c for c in ("uses",) if c in e.columns])


def _attribute(a: Column, e: Column) -> Column:
    folded = F.endswith(a["op"], F.lit("i"))
    fold = lambda x: F.when(folded, F.lower(x)).otherwise(x)
    have, want, op = fold(F.try_element_at(e["attrs"], a["name"])), fold(a["value"]), F.rtrim(a["op"], F.lit("i"))
    some = F.length(want) > 0
    tests = {
        "": F.lit(True), "=": have == want, "~=": F.array_contains(F.split(have, r"\s+"), want), "|=": (have == want) | F.startswith(have, F.concat(want, F.lit("-"))),
        "^=": some & F.startswith(have, want), "$=": some & F.endswith(have, want), "*=": some & F.contains(have, want),
    }
    picked = F.lit(False)
    for name, test in tests.items():
        picked = F.when(op == name, test).otherwise(picked)
    return F.coalesce(have.isNotNull() & picked, F.lit(False))


def _order(o: Column, e: Column) -> Column:
    p = F.lit(0)
    for name in ("at", "from_end", "of_type", "of_type_from_end", "root", "empty"):
        p = F.when(o["counter"] == name, e[name]).otherwise(p)
    steps = p - o["b"]
    return F.when(o["a"] == 0, steps == 0).otherwise((steps % o["a"] == 0) & (steps / o["a"] >= 0))


def _lite(c: Column, e: Column) -> Column:
    own = F.size(F.array_except(c["ids"], F.array(e["id"]))) + F.size(F.array_except(c["classes"], e["classes"])) == 0
    return (c["tag"].isNull() | (c["tag"] == e["tag"])) & own & F.forall(c["attrs"], lambda a: _attribute(a, e)) & F.forall(c["orders"], lambda o: _order(o, e))


def fits(c: Column, e: Column) -> Column:
    """Whether an element, as in positioned(), fits a compound."""
    return _lite(c, e) & ~F.exists(c["nots"], lambda x: _lite(x, e)) & F.forall(c["anys"], lambda some: F.exists(some, lambda x: _lite(x, e)))


def candidates(elements: DataFrame, rules: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """The elements that each compound of each selector fits by itself.

    With uses (page_id, sheet, rule_page, rule_sheet) pages have sheets in common: rules are those of the pages and sheets that uses names, at most
    FEW_PARTS compounds, and are broadcast, so that elements go to their page's sheets and are shuffled once, without a row for each key.
    """
    parts = rules.select(*KEYS, *FLAGS, F.size("compounds").alias("n"), F.posexplode("compounds").alias("k", "c"))
    key = F.coalesce(F.concat(F.lit("#"), F.get("c.ids", 0)), F.concat(F.lit("."), F.get("c.classes", 0)), F.col("c.tag"), F.lit("*"))
    keys = F.array_union(F.array(F.lit("*"), F.col("e.tag"), F.concat(F.lit("#"), F.col("e.id"))), F.transform("e.classes", lambda x: F.concat(F.lit("."), x)))
    inner = lambda c, f: F.exists(c["orders"], f) | F.exists(c["nots"], lambda x: F.exists(x["orders"], f)) | F.exists(c["anys"], lambda some: F.exists(some, lambda x: F.exists(x["orders"], f)))
    empty = not rules.where(F.exists("compounds", lambda c: inner(c, lambda o: o["counter"] == "empty"))).isEmpty()
    if uses is None:
        rows = positioned(elements, empty).withColumn("key", F.explode(keys)).join(parts.withColumn("key", key), ["page_id", "key"])
    else:
        of_page = uses.groupBy("page_id").agg(F.collect_list(F.struct("sheet", "rule_page", "rule_sheet")).alias("uses"))
        rows = positioned(dom.paths(elements).join(of_page, "page_id"), empty).withColumn("use", F.explode("uses")).withColumn("key", F.explode(keys))
        named = parts.withColumnsRenamed({"page_id": "rule_page", "sheet": "rule_sheet"}).withColumn("key", key)
        rows = rows.withColumns({c: F.col(f"use.{c}") for c in ("sheet", "rule_page", "rule_sheet")}).join(F.broadcast(named), ["rule_page", "rule_sheet", "key"])
    rows = rows.where(fits(F.col("c"), F.col("e")))
    return rows.select(*KEYS, *FLAGS, "k", "n", F.col("c.combinator").alias("combinator"), "el_id", "parent_id", "prev_id", "pre", "path")


def matches(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, sheet, sel_id, el_id of the elements that compiled selectors (css.compile_sheets) fit."""
    return _fitting(candidates(elements, rules)).select(*KEYS, "el_id")


def _fitting(found: DataFrame) -> DataFrame:
    """KEYS, FLAGS, el_id of the elements that fit whole selectors, from those that fit compounds."""
    found = written(found, "candidates")
    most = found.agg(F.max("n")).first()[0] or 0
    fit = found.where("k = 0")
    done = fit.where("n = 1").select(*KEYS, *FLAGS, "el_id")
    for k in range(1, most):
        now, by = found.where(F.col("k") == k), list(KEYS)
        placed = lambda name: fit.select(*KEYS, F.col("el_id").alias(name)).distinct()  # noqa: E731, B023
        above = now.where("combinator = ' '").select("*", F.explode("path").alias("anc_id")).where("anc_id <> el_id").join(placed("anc_id"), [*by, "anc_id"], "left_semi").drop("anc_id").distinct()
        child = now.where("combinator = '>'").join(placed("parent_id"), [*by, "parent_id"], "left_semi")
        beside = now.where("combinator = '+'").join(placed("prev_id"), [*by, "prev_id"], "left_semi")
        first = fit.groupBy(*KEYS, "parent_id").agg(F.min("pre").alias("first"))
        after = now.where("combinator = '~'").join(first, [*by, "parent_id"]).where("pre > first").drop("first")
        fit = above.unionByName(child).unionByName(beside).unionByName(after)
        fit = fit if k + 1 == most else written(fit, "fit")  # the last step is read once
        done = done.unionByName(fit.where(F.col("n") == k + 1).select(*KEYS, *FLAGS, "el_id"))
    return done.distinct()


def styled(elements: DataFrame, width: float = 1440, height: float = 900, sheets: DataFrame | None = None) -> DataFrame:
    """page_id, el_id, hover_styled (F13), order_styled, attr_styled (F14) of elements that a selector of those kinds fits.

    Selectors with :hover are matched without it; those that order or attributes decide count only if they have no :hover.
    Without sheets (page_id, sheet, css, media) those of the pages' own style elements count.
    """
    own = css.sheets_of(elements) if sheets is None else sheets
    named = own.select("page_id", "sheet", "css", "media", F.md5(F.concat(F.coalesce("css", F.lit("")), F.lit("\0"), F.coalesce("media", F.lit("")))).alias("digest"))
    kinds = written(named.dropDuplicates(["digest"]), "sheets")
    rules = css.compile_sheets(kinds, width, height)
    rules = written(rules.where("hover OR by_order OR by_attr"), "rules")
    used = kinds.join(rules.select("page_id", "sheet").distinct(), ["page_id", "sheet"], "left_semi").select("digest", F.col("page_id").alias("rule_page"), F.col("sheet").alias("rule_sheet"))
    if (rules.agg(F.sum(F.size("compounds"))).first()[0] or 0) <= FEW_PARTS:
        found = candidates(elements, rules, named.select("page_id", "sheet", "digest").join(F.broadcast(used), "digest").drop("digest"))
    else:
        uses = named.select("page_id", "sheet", "digest").join(used, "digest").drop("digest")
        of_rule = rules.withColumnsRenamed({"page_id": "rule_page", "sheet": "rule_sheet"})
        found = candidates(elements, uses.join(of_rule, ["rule_page", "rule_sheet"]).drop("rule_page", "rule_sheet"))
    of = lambda c: F.bool_or(F.col(c) & ~F.col("hover"))
    return _fitting(found).groupBy("page_id", "el_id").agg(F.bool_or("hover").alias("hover_styled"), of("by_order").alias("order_styled"), of("by_attr").alias("attr_styled"))
