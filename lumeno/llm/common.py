"""What the corpus operators share: word rules, shared folders, written tables."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeno.plans.shared import scratch, shared_dir, written  # noqa: F401  used by the operators

#: Words are maximal runs of anything but these six characters; bytes.split() with no argument cuts at the same six.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def held_out(doc_id: int | None) -> bool:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def held_out_col(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def zipped(df: DataFrame, name: str) -> DataFrame:
    """Like written, with a slower compression that makes less: for tables of hashes and numbers."""
    return written(df, name, compression="zstd")


#: Into how many parts the rows of one key are dealt where a key may be hot.
SALTS = 16


def lookup(rows: DataFrame, key: str, values: DataFrame, salt: Column, how: str = "inner") -> DataFrame:
    """rows with the columns of values, which has one row for each key.

    A plain join would bring all rows of a hot key to one task. Here its rows are dealt to SALTS parts by `salt`, and the
    key's values go to the parts that exist; these are found with partial distinct first.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    spread = dealt.select(key, "_salt").distinct().join(values, key)
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


#: Rows of one key from which on they are not brought to one task.
HOT = 20_000


def matched(rows: DataFrame, key: str, values: DataFrame, n: str = "n", most: int = 1_000_000) -> DataFrame:
    """rows with the columns of values but n, which says how many rows each key has.

    Keys of more than HOT rows are joined where their rows are: by broadcast if they are at most `most`, else dealt to parts.
    The other keys' rows are shuffled, without those of hot keys.
    """
    hot, cold = values.where(F.col(n) > HOT).drop(n), values.where(F.col(n) <= HOT).drop(n)
    if hot.isEmpty():
        return rows.join(cold, key)
    if _smaller_or_equal(hot, most):
        few = F.broadcast(hot)
        return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(cold, key))
    return lookup(rows, key, values.drop(n), F.struct(*rows.columns))


def fresh(name: str, df: DataFrame) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def _smaller_or_equal(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi", most: int = 1_000_000) -> DataFrame:
    """docs whose id is (left_semi) or isn't (left_anti) in ids, null ids included; at most `most` ids are broadcast, more are joined by shuffle."""
    name = fresh("only", docs)
    named = ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    named = F.broadcast(named) if _smaller_or_equal(named, most) else named
    return docs.join(named, F.col(id_col).eqNullSafe(F.col(name)), how)


#: Edges of one node from which on they are dealt to parts.
MANY_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the least node it is connected with.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until they change nothing; after each the edges are
    written, so neither the plan nor what a lost executor takes along grows. The edges of a node meet in one task unless
    they are more than MANY_EDGES; then they are dealt to parts.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, many = now, now["n"] > MANY_EDGES
        large = _star(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), True, many)
        edges = written(_star(written(large, "edges") if many else large, False, many), "edges")


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """Of each u, all larger neighbours (large) or all smaller ones and itself (not large) with the least of its neighbours and itself."""
    hot = many and not edges.groupBy("u").count().where(F.col("count") > MANY_EDGES).isEmpty()
    dealt = edges if hot else edges.repartition("u")
    least = dealt.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    rows = dealt.where("v > u") if large else dealt
    joined = lookup(rows, "u", least, F.col("v")) if hot else rows.join(least.hint("merge"), "u")
    made = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (made if large else made.union(least.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
