"""Styles of text, alignment, spacing, backgrounds, and maps of style values (M6, M10, map helpers, T9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def font_flags(weight: Column, style: Column, decoration: Column) -> dict[str, Column]:
    """thin, bold, italic, underline."""
    return {"thin": weight <= 300, "bold": weight >= 500, "italic": style.isin("italic", "oblique"), "underline": decoration != "none"}


def line_gap(line_height: Column, font_size: Column) -> Column:
    """Half of what a line has beyond its font; 0 for `normal`. Both are CSS lengths in pixels."""
    return F.when(line_height == "normal", 0.0).otherwise((pixels(line_height) - font_size) / 2)


def pixels(length: Column) -> Column:
    """The number that a CSS length begins with; null if there is none."""
    return F.regexp_extract(length, r"^\s*([-+]?\d*\.?\d+)", 1).try_cast("double")


def letter_spacing(value: Column) -> Column:
    return F.when(value == "normal", 0.0).otherwise(pixels(value))


def alignment(text_align: Column, direction: Column) -> Column:
    """start and end by the direction of writing."""
    forth, back = F.when(direction == "ltr", "left").otherwise("right"), F.when(direction == "ltr", "right").otherwise("left")
    return F.when(text_align == "start", forth).when(text_align == "end", back).otherwise(text_align)


def background(css: Column, image: Column, sampled: Column, opaque: float = 0.9) -> Column:
    """The CSS background color if it is opaque and without image, else the average of the sampled pixels."""
    clear = (F.coalesce(F.get(css, 3), F.lit(1.0)) < opaque) | (F.coalesce(image, F.lit("none")) != "none")
    return F.when(clear, sampled).otherwise(css)


def with_prefix(values: Column, prefix: str) -> Column:
    """A map with the prefix before each key."""
    return F.transform_keys(values, lambda k, _: F.concat(F.lit(prefix), k))


def without_equal(one: Column, two: Column) -> Column:
    """The entries of the first map whose value in the second one is another or missing."""
    return F.map_filter(one, lambda k, v: ~v.eqNullSafe(F.try_element_at(two, k)))


def picked(values: Column, keys: list[str]) -> Column:
    """The entries of these keys, in their order; null for missing ones."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.try_element_at(values, F.lit(k)) for k in keys]))


def character_kinds(text: Column) -> dict[str, Column]:
    """How many characters are digits, letters and capital letters of the Latin alphabet."""
    n = F.length(text)
    return {k: n - F.length(F.regexp_replace(text, p, "")) for k, p in (("digits", "[0-9]"), ("letters", "[A-Za-z]"), ("capitals", "[A-Z]"))}
