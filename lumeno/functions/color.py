"""Colors: arrays of red, green, blue (0 to 255) and, where there are four, alpha."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ, and the D65 white point.
TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (95.047, 100.0, 108.883)
#: Two colors differ if their channels differ by more than this in all.
VISIBLE_DIFFERENCE = 0.06 * 255


def css_color(s: Column) -> Column:
    """rgb(1, 2, 3) or rgba(1, 2, 3, 0.5) as an array of doubles."""
    return F.transform(F.split(F.regexp_replace(s, r"^[^(]*\(|\)\s*$", ""), r"\s*,\s*"), lambda x: x.cast("double"))


def xyz(rgb: Column) -> Column:
    linear = F.transform(rgb, lambda v: F.when(v / 255 > 0.04045, F.pow((v / 255 + 0.055) / 1.055, 2.4)).otherwise(v / 255 / 12.92))
    return F.array(*[100 * sum((linear[k] * c for k, c in enumerate(row)), F.lit(0.0)) for row in TO_XYZ])


def lab(rgb: Column) -> Column:
    at = xyz(rgb)
    x, y, z = (F.when(at[k] / w > 0.008856, F.pow(at[k] / w, F.lit(1 / 3))).otherwise(7.787 * at[k] / w + 16 / 116) for k, w in enumerate(WHITE))
    return F.array(116 * y - 16, 500 * (x - y), 200 * (y - z))


def luminance_contrast(one: Column, two: Column) -> Column:
    """Of the Lab lightnesses, to three digits."""
    a, b = lab(one)[0], lab(two)[0]
    return F.round((F.greatest(a, b) / 100 + 0.05) / (F.least(a, b) / 100 + 0.05), 3)


def rgb_contrast(one: Column, two: Column) -> Column:
    """Root mean square difference of the channels, to one digit."""
    return F.round(F.sqrt(sum(((one[k] - two[k]) * (one[k] - two[k]) for k in range(3)), F.lit(0.0)) / 3), 1)


def differ(one: Column, two: Column) -> Column:
    return sum((F.abs(one[k] - two[k]) for k in range(3)), F.lit(0.0)) > VISIBLE_DIFFERENCE


def over(rgba: Column, background: Column) -> Column:
    """A color with alpha (0 to 1) on an opaque background."""
    a = F.coalesce(F.get(rgba, 3), F.lit(1.0))
    return F.array(*[rgba[k] * a + background[k] * (1 - a) for k in range(3)])


def alpha_byte(alpha: Column) -> Column:
    return F.floor(alpha * 255 + 0.5)


def joined(color: Column) -> Column:
    return F.array_join(F.transform(color, lambda x: x.cast("string")), "_")
