"""Text scrambling (T11, T12): letters and digits change places, the look of a text stays."""

from __future__ import annotations

import random
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scrambled(text: str | None, seed: int = 0) -> str | None:
    """Letters permuted among letter positions and digits among digit positions; each position keeps its case, all else its place."""
    if text is None:
        return None
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) ^ seed)
    letters = [c.lower() for c in text if c.isalpha() and len(c.lower()) == 1 and len(c.lower().upper()) == 1]
    digits = [c for c in text if c.isdigit()]
    r.shuffle(letters)
    r.shuffle(digits)
    out = []
    for c in text:
        if c.isdigit():
            out.append(digits.pop())
        elif c.isalpha() and len(c.lower()) == 1 and len(c.lower().upper()) == 1:
            x = letters.pop()
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def scramble(text: Column, seed: int = 0) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([scrambled(x, seed) for x in s], dtype=object)

    return run(text)


def black(text: Column) -> Column:
    """A block for every character."""
    return F.repeat(F.lit("█"), F.length(text))
