"""Lines, columns and widths of paragraphs."""

import random

from pyspark.sql import functions as F

from lumeno.operators import paragraphs as P


def frame(spark, rows):
    return spark.createDataFrame([(1, g, float(a), float(b), float(c), float(d)) for g, a, b, c, d in rows], "page_id long, g int, l double, t double, r double, b double")


def test_lines_and_columns_equal_plain_ones(spark):
    r = random.Random(3)
    rows = [(g, x := r.randint(0, 300), y := r.randint(0, 60), x + r.randint(1, 80), y + 10) for g in range(60) for _ in range(r.randint(1, 9))]
    f = frame(spark, rows)
    lines = {x.g: (x.n_lines, x.lines_width) for x in P.line_counts(f, "g").collect()}
    columns = {x.g: x.n_columns for x in P.column_counts(f, "g").collect()}
    for g in range(60):
        own = sorted((t, lo, hi) for k, lo, t, hi, _ in rows if k == g)
        made = []
        for t, lo, hi in own:
            if made and t - made[-1][0] < 5:
                made[-1] = (made[-1][0], min(made[-1][1], lo), max(made[-1][2], hi))
            else:
                made.append((t, lo, hi))
        assert lines[g] == (len(made), sum(hi - lo for _, lo, hi in made))
        merged = []
        for lo, hi in sorted((lo, hi) for _, lo, hi in own):
            if merged and lo < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        assert columns[g] == len(merged)


def test_widths(spark):
    row = spark.range(1).select(P.pure_width(F.lit("ill W"), F.lit(10.0)).alias("w"), P.characters(F.lit(0.0), F.lit(10.0)).alias("none"), P.characters(F.lit(0.1), F.lit(10.0)).alias("one"), P.characters(F.lit(5.7), F.lit(10.0), "Lorem").alias("two"), P.characters(F.lit(1000.0), F.lit(10.0), "Lorem").alias("over")).first()
    assert abs(row.w - 10 * (3 * 0.22 + 0.28 + 0.94)) < 1e-9 and (row.none, row.one, row.two, row.over) == (0, 1, 2, None)


def test_hard_sized_texts_are_left_out(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, 50.0, 10.0), (2, 10.0, 10.0, 10.0, 10.0, 50.0, 10.0), (3, 0.0, 5.0, 10.0, 10.0, 10.0, 10.0), (4, 0.0, 5.0, 10.0, 10.0, 10.0, 90.0)]
    t = spark.createDataFrame(rows, "el_id int, empty_w double, empty_h double, w double, h double, large_w double, large_h double")
    assert [x.el_id for x in P.flowing(t).orderBy("el_id").collect()] == [1, 4]


def test_common_size_of_equal_ones_is_the_first(spark):
    t = spark.createDataFrame([(1, 12.2, 5, 3), (1, 11.9, 5, 4), (1, 20.0, 10, 1), (2, 9.0, 1, 1)], "g int, font_size double, n_chars int, ord int")
    assert {x.g: x.font_size for x in P.common_size(t, "g").collect()} == {1: 20.0, 2: 9.0}
