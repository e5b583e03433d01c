"""Snapshots from static HTML, where no captured ones exist.

A stand-in layout, not a browser's: elements lie below each other in document order, indented by depth. data-* attributes
state what is known: data-box="l,t,r,b", data-font, data-weight, data-position, data-overflow, data-opacity, data-bg,
data-color, data-cursor, data-hidden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumeno.functions.color import css_color
from lumeno.operators import selectors
from lumeno.plans.shared import broadcast_measured, written
from lumeno.sources import html

LINE, INDENT, WIDTH = 12.0, 8.0, 1440.0
#: Font sizes of a browser's default style (fixed values).
SIZES = {"h1": 32.0, "h2": 24.0, "h3": 18.7, "h4": 16.0, "h5": 13.3, "h6": 10.7}


def from_elements(elements: DataFrame) -> DataFrame:
    broadcast_measured(elements.sparkSession)
    a: dict[str, Column] = {k: F.col("attrs")[f"data-{k}"] for k in ("box", "font", "weight", "position", "overflow", "opacity", "bg", "color", "cursor", "hidden", "image")}
    b = F.transform(F.split(a["box"], ","), lambda x: x.cast("double"))
    flow = {"l": F.col("depth") * INDENT, "t": F.col("pre") * LINE, "r": WIDTH - F.col("depth") * INDENT, "b": (F.col("post") + 1) * LINE}
    size = F.coalesce(a["font"].cast("double"), *[F.when(F.col("tag") == t, v) for t, v in SIZES.items()], F.lit(16.0))
    made = elements.select(
        "*", *[F.coalesce(F.get(b, k), v).cast("double").alias(n) for k, (n, v) in enumerate(flow.items())],
        size.alias("font_size"), F.coalesce(a["weight"].cast("int"), F.lit(400)).alias("font_weight"),
        F.coalesce(a["position"], F.lit("static")).alias("position"), F.coalesce(a["overflow"], F.lit("visible")).alias("overflow"),
        F.coalesce(a["opacity"].cast("double"), F.lit(1.0)).alias("opacity"), F.lit("visible").alias("visibility"),
        F.when(F.col("tag").isin("head", "script", "style", "title", "meta", "link") | a["hidden"].isNotNull(), "none").otherwise("block").alias("display"),
        F.coalesce(css_color(a["color"]), F.array(*[F.lit(0.0)] * 3)).alias("color"), F.coalesce(css_color(a["bg"]), F.array(*[F.lit(255.0)] * 3)).alias("bg_color"), a["image"].alias("bg_image"),
        F.coalesce(a["cursor"], F.lit("auto")).alias("cursor"), F.lit(False).alias("hover_styled"), a["hidden"].isNull().alias("visible"), F.lit(WIDTH).alias("doc_width"),
    )
    return made.where("page_id IS NOT NULL").withColumn("doc_height", F.greatest(F.max("b").over(Window.partitionBy("page_id")), F.lit(900.0)))


def from_pages(pages: DataFrame, hover: bool = False) -> DataFrame:
    """Snapshot rows of static pages; with hover, hover_styled comes from the pages' own style sheets."""
    elements = html.parse(pages)
    if not hover:
        return from_elements(elements)
    elements = written(elements, "elements")
    found = selectors.styled(elements).where("hover_styled").select("page_id", "el_id", F.lit(True).alias("_hover"))
    made = from_elements(elements).join(found, ["page_id", "el_id"], "left")
    return made.withColumn("hover_styled", F.coalesce("_hover", F.lit(False))).drop("_hover")
