"""Computed controls once logos, menus, borders and backgrounds are known (F16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeno.operators import bars, dom
from lumeno.plans.shared import written

#: By how much an element may be larger than the control it outlines (fixed value).
MOST_LARGER = 0.1
KEYS = ["page_id", "el_id"]


def _holders(elements: DataFrame, of: DataFrame, among: DataFrame) -> DataFrame:
    """page_id, el_id of those among that hold one of `of`, or are it, and how many they hold as n."""
    rows = dom.above(elements.join(of.select(*KEYS).distinct(), KEYS, "left_semi"), F.col("el_id").alias("_in"))
    return rows.withColumnRenamed("anc_id", "el_id").join(among.select(*KEYS).distinct(), KEYS, "left_semi").groupBy(*KEYS).agg(F.count("*").alias("n"))


def _within(elements: DataFrame, of: DataFrame, holders: DataFrame) -> DataFrame:
    """page_id, el_id of `of` that are one of the holders or stand in one."""
    rows = dom.above(elements.join(of.select(*KEYS).distinct(), KEYS, "left_semi"), "el_id")
    return rows.join(holders.select("page_id", F.col("el_id").alias("anc_id")).distinct(), ["page_id", "anc_id"], "left_semi").select(*KEYS).distinct()


def outlines(elements: DataFrame, controls: DataFrame, edged: DataFrame) -> DataFrame:
    """page_id, el_id (the control), edge_id of edged elements that hold a control and are little larger on both axes."""
    size = lambda p: ((F.col("r") - F.col("l")).alias(f"{p}_w"), (F.col("b") - F.col("t")).alias(f"{p}_h"))
    e = bars.float_proof(dom.paths(elements))
    own = dom.above(e.join(controls.select(*KEYS).distinct(), KEYS, "left_semi"), "el_id", *size("c"))
    edge = e.join(edged.select(*KEYS).distinct(), KEYS, "left_semi").select("page_id", F.col("el_id").alias("anc_id"), *size("e"))
    near = own.join(edge, ["page_id", "anc_id"]).where((F.col("e_w") <= F.col("c_w") * (1 + MOST_LARGER)) & (F.col("e_h") <= F.col("c_h") * (1 + MOST_LARGER)))
    return near.select("page_id", "el_id", F.col("anc_id").alias("edge_id"))


def checked(elements: DataFrame, controls: DataFrame, logos: DataFrame, menus: DataFrame, edged: DataFrame, texts: DataFrame, pictures: DataFrame) -> DataFrame:
    """The elements that remain of computed controls; all sets have page_id, el_id, and edged are those with a border or a background of their own.

    Controls in or around a logo go. One that holds text but no picture stays in a menu, or if it holds an edged
    element; otherwise the edged elements that outline it take its place, and without any it goes. Of nested ones the outermost stay.
    """
    e = dom.paths(elements)
    ids = controls.select(*KEYS).distinct()
    # Sets that are read several times are written, else each reading makes them anew.
    free = written(ids.join(_within(e, ids, logos), KEYS, "left_anti").join(_holders(e, logos, ids), KEYS, "left_anti"), "free")
    words = written(_holders(e, texts, free).join(_holders(e, pictures, free), KEYS, "left_anti"), "words")
    kept = words.join(_within(e, words, menus).unionByName(_holders(e, edged, words).select(*KEYS)).distinct(), KEYS, "left_semi")
    bare = written(words.join(kept, KEYS, "left_anti"), "bare")
    new = outlines(e, bare, edged).select("page_id", F.col("edge_id").alias("el_id"))
    found = written(free.join(bare, KEYS, "left_anti").unionByName(new).distinct(), "found")
    return dom.outermost(elements.join(found, KEYS, "left_semi"))
