"""Paragraphs with their box, lines, columns and width.

Rows are text nodes (page_id, el_id, own_text, font_size) and the rectangles of their lines (page_id, el_id, l, t, r, b). A
paragraph is a block and the texts whose nearest block it is. What has to follow the order of a paragraph's lines is one fold over its
sorted rectangles; columns are islands of overlapping intervals, found by a running maximum.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumeno.operators import dom

#: Tops that are closer than this are one line (fixed value).
SAME_LINE = 5.0
#: Advance widths in shares of the font size, by character; others have OTHER_ADVANCE. Rounded values of a common sans serif font.
ADVANCES = dict.fromkeys("ijl'|", 0.22) | dict.fromkeys("ft.,:;!/ I[]", 0.28) | dict.fromkeys("r-()", 0.33) | dict.fromkeys("ckszvxyJ*\"", 0.5) | dict.fromkeys("abdeghnopquL0123456789$?_", 0.56) | dict.fromkeys("FTZ", 0.61) | dict.fromkeys("ABEKPSVXY&", 0.67) | dict.fromkeys("wCDHNRU", 0.72) | dict.fromkeys("GOQ", 0.78) | dict.fromkeys("mM", 0.83) | dict.fromkeys("W", 0.94)
OTHER_ADVANCE = 0.56
#: The text that is filled in to measure a width in characters, repeated.
SAMPLE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
SAMPLE_TIMES = 20


def flowing(texts: DataFrame) -> DataFrame:
    """Text nodes whose size is not set by hand (P2): captured without text (empty_w, empty_h) they have none, and with much text
    (large_w, large_h) another one than w, h."""
    return texts.where(((F.col("empty_w") == 0) | (F.col("empty_h") == 0)) & ((F.col("w") != F.col("large_w")) | (F.col("h") != F.col("large_h"))))


def _lines(rects: Column) -> Column:
    """n (lines) and width (of all lines together) of rectangles sorted by top: those within SAME_LINE of a line's first one are one line."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        new = s["top"].isNull() | (x["t"] - s["top"] >= SAME_LINE)
        pick = lambda fresh, kept: F.when(new, fresh).otherwise(kept)
        return F.struct((s["n"] + pick(F.lit(1), F.lit(0))).alias("n"), pick(x["t"], s["top"]).alias("top"), pick(x["l"], F.least(s["lo"], x["l"])).alias("lo"), pick(x["r"], F.greatest(s["hi"], x["r"])).alias("hi"), (s["sum"] + pick(s["hi"] - s["lo"], F.lit(0.0))).alias("sum"))

    return F.aggregate(rects, start, step, lambda s: F.struct(s["n"].alias("n"), (s["sum"] + s["hi"] - s["lo"]).alias("width")))


def line_counts(rects: DataFrame, *by: str) -> DataFrame:
    """by, n_lines, lines_width of each group of rectangles (P5)."""
    made = rects.groupBy(*by).agg(_lines(F.sort_array(F.collect_list(F.struct("t", "l", "r", "b")))).alias("v"))
    return made.select(*by, F.col("v.n").alias("n_lines"), F.col("v.width").alias("lines_width"))


def column_counts(rects: DataFrame, *by: str) -> DataFrame:
    """by, n_columns: how many columns rectangles make if those that share more than an edge from left to right are in one (P5)."""
    before = F.max("r").over(Window.partitionBy(*by).orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | (F.col("l") >= before)
    return rects.withColumn("_new", new.cast("int")).groupBy(*by).agg(F.sum("_new").alias("n_columns"))


def characters(width: Column, font_size: Column, sample: str = SAMPLE * SAMPLE_TIMES) -> Column:
    """How many characters of the sample it takes to fill a width (P6); null if all of them don't."""
    sums = F.array(*[F.lit(round(x, 4)) for x in itertools.accumulate(ADVANCES.get(c, OTHER_ADVANCE) for c in sample)])
    n = F.size(F.filter(sums, lambda x: x * font_size < width)) + 1
    return F.when(width <= 0, 0).when(n <= len(sample), n)


def pure_width(text: Column, font_size: Column) -> Column:
    """The width of a text on one line."""
    table = F.create_map(*[F.lit(x) for pair in ADVANCES.items() for x in pair])
    return F.aggregate(F.split(text, ""), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(OTHER_ADVANCE)))) * font_size


def common_size(texts: DataFrame, *by: str) -> DataFrame:
    """by, font_size (rounded): the one that most characters have; of equal ones that of the first text (columns n_chars, ord)."""
    per = texts.groupBy(*by, F.round("font_size").alias("font_size")).agg(F.sum("n_chars").alias("n"), F.min("ord").alias("first"))
    return per.groupBy(*by).agg(F.max_by("font_size", F.struct("n", -F.col("first"))).alias("font_size"))


def paragraphs(elements: DataFrame, rects: DataFrame, split: bool = False) -> DataFrame:
    """page_id, el_id, text, n_texts, l, t, r, b, n_lines, lines_width, n_columns, font_size, width_chars.

    el_id is the block, or with split each text node, which then is a paragraph of its own (P3). One line is one column.
    """
    texts = dom.with_text(elements)
    if split:
        near = texts.select("page_id", "el_id", F.col("el_id").alias("anc_id"))
    else:
        near = dom.nearest_ancestor(texts, elements.where(F.col("tag").isin(*dom.BLOCKS)), strict=False).select("page_id", "el_id", "anc_id")
    own = near.join(texts.select("page_id", "el_id", F.col("pre").alias("ord"), "font_size", dom.text_of(F.col("own_text")).alias("x")), ["page_id", "el_id"]).withColumn("n_chars", F.length("x"))
    by = ["page_id", "anc_id"]
    words = own.groupBy(*by).agg(F.count("*").alias("n_texts"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "x"))), lambda v: v["x"]), "").alias("text"))
    lines = near.join(rects.select("page_id", "el_id", *"ltrb"), ["page_id", "el_id"])
    box = lines.groupBy(*by).agg(*[f(k).alias(k) for k, f in (("l", F.min), ("t", F.min), ("r", F.max), ("b", F.max))])
    made = words.join(box, by).join(line_counts(lines, *by), by).join(column_counts(lines, *by), by).join(common_size(own, *by), by)
    made = made.withColumn("n_columns", F.when(F.col("n_lines") > 1, F.col("n_columns")).otherwise(F.lit(1)))
    return made.withColumn("width_chars", characters(F.col("r") - F.col("l"), F.col("font_size"))).withColumnRenamed("anc_id", "el_id")
