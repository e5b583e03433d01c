"""Quality rules: decision lists learned by sequential covering, in Spark expressions.

Every text gets counts and shares from built-in functions alone. Statistics of labelled texts teach an ordered list of
rules, each a conjunction of thresholds such as `symbol_share > 0.03 AND n_words <= 900`. A rule is grown on two thirds of
what is left uncovered, condition by condition, by the gain of information; on the other third it is pruned from its end
as long as that raises its worth; then the rows it covers are taken away. The list ends when the next rule is no better than chance. It
becomes one CASE expression: the first rule that holds decides, else the text is kept.

Learning is bounded: at most `SAMPLE` labelled rows of each class reach the driver (as their statistics, not their texts),
the ones with the smallest hash of their id.

Defined results: null and empty texts have counts of 0 and fail the base rule; repeated rows are judged each; without
labels of both classes there are no rules; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeno.llm.common import SPACE, SPACE_RE, held_out_col

SAMPLE = 4000
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What rules may ask about.
FEATURES = ("n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "distinct_share", "words_per_line")
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 24


def _without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the counts, and the shares of FEATURES; with carry also _row, the whole input row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] * carry
    base = docs.select(F.col(id_col).alias("doc_id"), t.alias("_t"), *row)
    # Words come from the text with single spaces; splitting at a fixed character needs no regular expression.
    base = base.withColumn("_w", F.filter(F.split(F.translate("_t", SPACE, " " * len(SPACE)), " "), lambda w: w != ""))
    n = F.size("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    base = base.withColumns({"_n": n, "_l": lines})
    # Three-word windows by their hashes; most texts have no equal ones. Where there are some, their words are compared.
    grams = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    base = base.withColumn("_g", F.when(F.col("_n") >= 3, grams).otherwise(F.array().cast("array<bigint>")))
    base = base.withColumn("_at", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), repeated_windows("_g", "_w")).otherwise(F.array().cast("array<int>")))
    base = base.withColumn("_d", covered_words("_at"))
    chars = _without(F.col("_t"), SPACE)
    full = F.length("_t")
    made = base.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        (full - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_d").cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        (full - _without(F.col("_t"), UPPER)).alias("_upper"),
        (full - _without(F.col("_t"), "0123456789")).alias("_digits"),
        (full - _without(F.col("_t"), "!")).alias("_bangs"),
        F.size(F.array_distinct("_w")).alias("_distinct"),
        *["_row"] * carry,
    )
    words, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return made.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / letters).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_upper") / letters).alias("upper_share"),
        (F.col("_digits") / letters).alias("digit_share"),
        (F.col("_bangs") / letters).alias("bang_share"),
        (F.col("_distinct") / words).alias("distinct_share"),
        (F.col("n_words") / F.greatest(F.col("_lines"), F.lit(1))).alias("words_per_line"),
        *["_row"] * carry,
    )


def repeated_windows(grams: str, words: str) -> Column:
    """The sorted positions of windows that occur twice or more: sorting (hash, position) pairs brings equal ones together."""
    pairs = F.sort_array(F.transform(F.col(grams), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def same(a: Column, b: Column) -> Column:
        equal = a["g"] == b["g"]
        for k in range(3):
            equal = equal & (F.get(words, a["i"] + k) == F.get(words, b["i"] + k))
        return equal

    both = F.zip_with(pairs, F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1))), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))


def covered_words(at: str) -> Column:
    """How many words windows of three at these sorted positions cover: each adds three, less what the next one covers too."""
    steps = F.zip_with(F.col(at), F.slice(F.col(at), 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p1, n1)."""
    return p1 * (math.log2((p1 + 1e-9) / (p1 + n1 + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p1 else 0.0


def covers(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for f, above, cut in rule:
        held &= x[:, f] > cut if above else x[:, f] <= cut
    return held


def grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    rule: list[tuple[int, bool, float]] = []
    held = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (bad[held] == 0).any():
        p0, n0 = int(bad[held].sum()), int((~bad[held]).sum())
        best = (0.0, None)
        for f in range(x.shape[1]):
            own = x[held, f]
            for cut in np.unique(np.round(np.quantile(own, np.linspace(0, 1, CUTS)), 4)):
                hit = own > cut
                p, n = int((hit & bad[held]).sum()), int((hit & ~bad[held]).sum())
                for above, p1, n1 in ((True, p, n), (False, p0 - p, n0 - n)):
                    g = gain(p0, n0, p1, n1)
                    if g > best[0] + 1e-12:
                        best = (g, (f, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        held &= covers(rule[-1:], x)
    return rule


def learn(rows: list[tuple[list[float], bool]], least_precision: float = 0.9) -> list[list[tuple[str, bool, float]]]:
    """An ordered list of rules for bad texts; rows are (features, bad)."""
    x, bad = np.array([r[0] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], bool)
    rules, part = [], np.arange(len(x)) % 3
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and (bad & left).any() and (~bad & left).any():
        g, p = left & (part < 2), left & (part == 2)
        if not bad[g].any():
            break
        rule = grow(x[g], bad[g])

        def worth(r: list, at: np.ndarray) -> float:
            held = covers(r, x[at])
            a, b = int((held & bad[at]).sum()), int((held & ~bad[at]).sum())
            return (a - b) / (a + b + 1)

        while len(rule) > 1 and worth(rule[:-1], p) >= worth(rule, p):
            rule = rule[:-1]
        held = covers(rule, x) & left
        hits, misses = int((held & bad).sum()), int((held & ~bad).sum())
        if not rule or hits < 3 or (hits + 1) / (hits + misses + 2) < min(least_precision, (hits + 1) / (hits + 2)):
            break
        rules.append([(FEATURES[f], above, cut) for f, above, cut in rule])
        left &= ~held
    return rules


def verdict(rules: list[list[tuple[str, bool, float]]]) -> Column:
    """The number of the first rule that holds, 0: none."""
    made = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        held = F.lit(True)
        for name, above, cut in rule:
            held = held & (F.col(name) > cut if above else F.col(name) <= cut)
        made = made.when(held, F.lit(k))
    return made.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[list[tuple[str, bool, float]]]:
    """Rules from at most 2 * per_class labelled rows whose ids are not held out."""
    marked = labels.where(~held_out_col(F.col(id_col)) & F.col("quality").isin(0, 1)).select(F.col(id_col).alias("_id"), F.col("quality").alias("_label"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"))
    picked = [marked.where(F.col("_label") == k).orderBy("_h", "_id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    stats = statistics(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(few, "_id"), "_id", "text", carry=True)
    rows = stats.select(F.col("_row._h").alias("h"), F.col("_row._label").alias("label"), *FEATURES).collect()
    return learn([([float(r[f]) for f in FEATURES], r["label"] == 0) for r in sorted(rows, key=lambda r: (r["h"], *(r[f] for f in FEATURES)))])


def judge(docs: DataFrame, labels: DataFrame, rules: list | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the number of the rule that rejected it; with carry also _row, the whole input row."""
    rules = fit(docs, labels, id_col=id_col, text_col=text_col) if rules is None else rules
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = statistics(docs, id_col, text_col, carry).withColumns({"base_failed": failed, "rule": verdict(rules)})
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule", *["_row"] * carry)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, less those that the base rule or a learned rule rejects."""
    made = judge(docs, labels, id_col=id_col, text_col=text_col, carry=True)
    # The row number keeps the filter above the statistics; moved below, it would repeat their expressions many times over.
    return made.withColumn("_at", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")
