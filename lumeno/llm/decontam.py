"""Benchmark decontamination by spaced-seed hashing, in built-in functions alone.

A seed is a fixed mask over `SPAN` consecutive words that looks at some and ignores the others, so a changed word spoils only
the seeds that look at it. Seeds of test items and of texts are hashed and joined. Around each hit the text and the item
are laid over each other: if at least `least` of the words of a window of up to `window` words agree, the text overlaps the item.
Items of `FEWEST` to SPAN - 1 words are one window; their three masks ignore a third of it each, so one changed word is tolerated.

What is broadcast is one row for each different seed and window: a key, two numbers and the item's window, at most
`window` hashes. At most `SEEDS` of them, whose size is so bounded whatever the items are, are broadcast at once; a larger
benchmark takes several passes over the texts, dealt by key. Texts are never shuffled: seeds are made, joined and verified in one
stage, and only verified hits are counted by text and item, with partial sums first.

Words are the runs of letters and digits of the lower-case text, compared by their 64-bit hash.

Defined results: null and empty texts, and items of fewer than FEWEST words, overlap nothing; repeated rows and ids are counted
together under their id (null ids too); equal items are reported each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeno.llm.common import lookup, only_ids, written

#: Words that each mask looks at; six of SPAN.
SPAN, FEWEST = 9, 5
MASKS = ((0, 1, 3, 4, 6, 8), (0, 1, 2, 5, 7, 8), (0, 2, 3, 5, 6, 8))
SEEDS = 300_000


def masks(span: int) -> tuple[tuple[int, ...], ...]:
    """The words each mask looks at: of shorter spans all but a third."""
    return MASKS if span == SPAN else tuple(tuple(i for i in range(span) if i * 3 // span != k) for k in range(3))


def hashed_words(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, h: str, at: str, spans: list[int]) -> DataFrame:
    """A row for each mask of the spans at each position, with its key."""
    n = F.size(h)
    rows = df.withColumn(at, F.explode(F.when(n >= min(spans), F.sequence(F.lit(0), n - min(spans)))))
    keys = [F.when(F.col(at) + span <= n, F.xxhash64(F.lit(4 * span + k), *[F.get(h, F.col(at) + o) for o in mask])) for span in spans for k, mask in enumerate(masks(span))]
    return rows.withColumn("_key", F.explode(F.array(*keys)))


def places(bench: DataFrame, window: int) -> DataFrame:
    """_key, item_ids, _d (from the window's begin to the seed), _w (the window's words), _y (their hashes) of the items' different seeds."""
    of = {span: bench.where((F.size("_b") >= SPAN) if span == SPAN else (F.size("_b") == span)) for span in range(FEWEST, SPAN + 1)}
    rows = reduce(DataFrame.unionAll, [seeds(some, "_b", "_j", [span]).withColumn("_span", F.lit(span)) for span, some in of.items()])
    width = F.least(F.lit(window), F.size("_b"))
    begin = F.greatest(F.lit(0), F.least(F.col("_j") - F.floor((width - F.col("_span")) / 2).cast("int"), F.size("_b") - width))
    rows = rows.select("_key", "item_id", (F.col("_j") - begin).alias("_d"), width.alias("_w"), F.slice("_b", begin + 1, width).alias("_y"))
    return rows.groupBy("_key", "_d", "_w", "_y").agg(F.collect_set(F.struct("item_id")).alias("_items"))


def overlaps(docs: DataFrame, items: DataFrame, window: int = 24, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", seeds_at_once: int | None = None) -> DataFrame:
    """doc_id, item_id, n_hits (verified), overlap (largest share of equal words in a window), contaminated (true) for each overlap."""
    bench = items.select(F.col(item_id).alias("item_id"), hashed_words(F.col(item_text)).alias("_b"))
    known = written(places(bench, window).withColumn("_n", F.monotonically_increasing_id()), "seeds")
    spans = [r["w"] for r in known.select(F.least("_w", F.lit(SPAN)).alias("w")).distinct().collect()]  # SPAN - FEWEST + 1 numbers at most
    members = known.select("_n", F.explode("_items").alias("_i")).select("_n", "_i.item_id")
    passes = max(1, -(-known.count() // (seeds_at_once or SEEDS)))
    texts = docs.select(F.col(id_col).alias("doc_id"), hashed_words(F.col(text_col)).alias("_h"))
    made = []
    for k in range(passes):
        some = known.where(F.pmod(F.xxhash64("_key"), F.lit(passes)) == k).select("_key", "_n", "_d", "_w", "_y")
        hits = seeds(texts, "_h", "_i", sorted(spans) or [SPAN]).join(F.broadcast(some), "_key")  # about SEEDS rows of bounded size
        hits = hits.withColumn("_s", F.col("_i") - F.col("_d"))
        # Both windows are cut out in the join's generated code, which stays small enough to be compiled, so a text's hits don't
        # carry the text along. The row number keeps the comparison (a lambda, never generated) from moving into the join.
        off = F.greatest(F.lit(0), -F.col("_s"))
        cut = hits.select(
            "doc_id", "_n", "_w", F.monotonically_increasing_id().alias("_row"),
            F.slice("_h", F.col("_s") + off + 1, F.col("_w") - off).alias("_x"),
            F.slice("_y", off + 1, F.col("_w") - off).alias("_y"),
        )
        share = F.size(F.filter(F.zip_with("_x", "_y", lambda x, y: x == y), lambda z: z)) / F.col("_w")
        made.append(cut.where((F.col("_row") >= 0) & (share >= least)).select("doc_id", "_n", share.alias("_share")))
    found = reduce(DataFrame.unionAll, made).groupBy("doc_id", "_n").agg(F.count("*").alias("n"), F.max("_share").alias("_share"))
    both = lookup(found, "_n", members, F.col("doc_id")).groupBy("doc_id", "item_id").agg(F.sum("n").alias("n_hits"), F.max("_share").alias("overlap"))
    return both.withColumn("contaminated", F.lit(True))


def without_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, less those that overlap an item; rows with equal ids share their fate."""
    return only_ids(docs, written(overlaps(docs, items, id_col=id_col, text_col=text_col).select("doc_id").distinct(), "leaks"), id_col, "left_anti")
