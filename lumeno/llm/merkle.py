"""A Merkle manifest of a dataset: a sparse-forest monoid, reduced in a tree of tasks.

Each source is a tree of its rows in order of id, and the roots of the sources are the leaves of one tree above them. Runs of
`ARITY` nodes become one. A forest is a set of nodes, keyed by tree, level and index, that are not in a complete run yet. Two
forests are added by taking both sets and folding each run that is complete; since the number of leaves of a tree is known,
the width of every level is, and with it whether a short last run is complete. A tree's root becomes a leaf of the tree above,
whose index is the source's rank. Addition is associative, and the forest of all rows has one node, the root.

Rows are dealt to parts by range of source and id, so that a part holds runs of neighbours and a source of any size is
divided. A part's forest has a handful of nodes a level. Reduction is a tree: `FAN` neighbouring forests at a time are added in
one task, and each round is a table, because the proofs go the same way down again: a node that a task left open gets its path to
the root from the round above, and hands it to those below. No task and not the driver holds more than a part's rows or FAN forests.

Defined results: a null field is written as `-`; an empty text is `0:`; null ids come first in their source; rows with equal
ids are ordered by their leaf, and repeated rows by the order in which they are read; a null id counts as the empty text for
its checksum; a null source is a source of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumeno.llm.common import written

ARITY, FAN = 3, 256
#: Rows of a part, unless that makes more than PARTS parts.
ROWS, PARTS = 16_384, 20_000
#: The tree above the sources' trees.
TOP = -1
Node = tuple[int, int, int]
Step = tuple[str, str]


def node_hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class Forest:
    """Nodes by (tree, level, index). `open` are those that aren't in a complete run yet; folded ones are kept for paths."""

    def __init__(self, n_trees: int):
        self.sizes, self.nodes, self.open = {TOP: n_trees}, {}, set()

    def width(self, tree: int, level: int) -> int:
        return -(-self.sizes[tree] // ARITY**level)

    def run(self, key: Node) -> range:
        """The indices of the run that a node is in."""
        tree, level, at = key
        first = at - at % ARITY
        return range(first, min(first + ARITY, self.width(tree, level)))

    def add(self, nodes: Iterable[tuple[Node, str, int]]) -> Forest:
        """The sum of this forest and nodes, each with its digest and the number of its tree's leaves."""
        fresh = []
        for key, digest, size in nodes:
            self.sizes[key[0]] = size
            self.nodes[key] = digest
            fresh.append(key)
        self.open.update(fresh)
        while fresh:
            made = []
            for key in fresh:
                tree, level, at = key
                if key not in self.open or (above := self._fold(key)) is None:
                    continue
                made.append(above)
            fresh = made
        return self

    def _fold(self, key: Node) -> Node | None:
        """Folds the node's run if all of it is here."""
        tree, level, at = key
        if self.width(tree, level) == 1:
            if tree == TOP:
                return None
            self.open.discard(key)
            above = (TOP, 0, tree)
            self.nodes[above] = self.nodes[key]
        else:
            run = [(tree, level, k) for k in self.run(key)]
            if any(k not in self.open for k in run):
                return None
            self.open.difference_update(run)
            above = (tree, level + 1, at // ARITY)
            self.nodes[above] = node_hash(*(self.nodes[k] for k in run))
        self.open.add(above)
        return above

    def steps(self, key: Node) -> tuple[list[Step], str | None, Node]:
        """From a node to the open one above it: digests left and right of the path at each level, the root of the node's tree if the path passes it, and the open node."""
        steps, subroot = [], None
        while key not in self.open:
            tree, level, at = key
            if self.width(tree, level) == 1:
                subroot, key = self.nodes[key], (TOP, 0, tree)
                continue
            run = self.run(key)
            steps.append(tuple("".join(self.nodes[tree, level, k] for k in some) for some in (range(run.start, at), range(at + 1, run.stop))))
            key = (tree, level + 1, at // ARITY)
        return steps, subroot, key


def folded(leaf: str, steps: Iterable[Step]) -> str:
    for left, right in steps:
        leaf = node_hash(left, leaf, right)
    return leaf


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields, each with its length in bytes."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


FOREST = "part long, tree long, level int, idx long, total long, digest string"
UPPER = "part long, tree long, level int, idx long, lefts array<string>, rights array<string>, subroot string, root string"


def placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows (doc_id, source, leaf, tampered) with their part, tree and index there, and the tree's size; the numbers of parts and trees."""
    leaves = written(leaves.withColumn("rid", F.monotonically_increasing_id()), "leaves")
    n = leaves.count()
    parts = min(-(-n // ROWS), PARTS) or 1
    order = [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("rid")]
    ordered = written(leaves.repartitionByRange(parts, F.asc_nulls_first("source"), *order).withColumn("part", F.spark_partition_id().cast("long")), "ordered")
    by = Window.partitionBy("source")
    sizes = ordered.groupBy("part", "source").agg(F.count("*").alias("n"))
    sizes = sizes.select("part", "source", F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(by).alias("total"), (F.col("part") == F.min("part").over(by)).alias("begins"))
    sizes = written(sizes, "sizes")
    begins = sizes.where("begins")
    # Sources that begin in earlier parts: a running sum of at most PARTS numbers.
    earlier = begins.groupBy("part").agg(F.count("*").alias("k")).select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("earlier"))
    ranked = begins.join(earlier, "part").select("source", (F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("source"))) - 1).cast("long").alias("tree"))
    named = sizes.alias("s").join(ranked.alias("r"), F.col("s.source").eqNullSafe(F.col("r.source"))).select("s.part", "s.source", "s.before", "s.total", "r.tree")
    at = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order))
    rows = ordered.alias("o").join(named.alias("n"), (F.col("o.part") == F.col("n.part")) & F.col("o.source").eqNullSafe(F.col("n.source")))
    rows = rows.select("o.part", "o.doc_id", "o.leaf", "o.tampered", "o.rid", "n.tree", "n.before", "n.total")
    last = ordered.agg(F.max("part")).first()[0]
    return written(rows.withColumn("idx", F.col("before") + at - 1).drop("before", "rid"), "placed"), (last or 0) + 1, begins.count()


def _nodes(t: pd.DataFrame) -> Iterable[tuple[Node, str, int]]:
    return (((a, b, c), d, n) for a, b, c, d, n in zip(t["tree"].tolist(), t["level"].tolist(), t["idx"].tolist(), t["digest"].tolist(), t["total"].tolist()))


def _left_open(part: int, forest: Forest) -> pd.DataFrame:
    rows = [(part, *key, forest.sizes[key[0]], forest.nodes[key]) for key in forest.open]
    return pd.DataFrame(rows, columns=["part", "tree", "level", "idx", "total", "digest"])


def _groups(forests: DataFrame) -> DataFrame:
    return forests.withColumn("group", F.floor(F.col("part") / FAN).cast("long"))


def reduced(forests: DataFrame, parts: int, trees: int) -> list[DataFrame]:
    """The rounds of the reduction: the parts' forests, their sums, and so on to the forest of all rows, which is the root."""

    def add(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        return _left_open(key[0], Forest(trees).add(_nodes(t)))

    rounds = [written(forests, "forests")]
    while parts > 1 or len(rounds) == 1:
        rounds.append(written(_groups(rounds[-1]).groupBy("group").applyInPandas(add, FOREST), "forests"))
        parts = -(-parts // FAN)
    return rounds


def uppers(rounds: list[DataFrame], trees: int) -> DataFrame:
    """For each node that a part left open its path to the root."""

    def down(below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(trees).add(_nodes(below))
        known = {(a, b, c): rest for a, b, c, *rest in above[["tree", "level", "idx", "lefts", "rights", "subroot", "root"]].itertuples(index=False)}
        rows = []
        for part, tree, level, at in below[["part", "tree", "level", "idx"]].itertuples(index=False):
            steps, subroot, key = forest.steps((tree, level, at))
            lefts, rights, later, root = known[key]
            rows.append((part, tree, level, at, [x for x, _ in steps] + list(lefts), [x for _, x in steps] + list(rights), subroot or later, root))
        return pd.DataFrame(rows, columns=["part", "tree", "level", "idx", "lefts", "rights", "subroot", "root"])

    none = F.array().cast("array<string>")
    made = rounds[-1].select("part", "tree", "level", "idx", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for below in reversed(rounds[:-1]):
        made = written(_groups(below).groupBy("group").cogroup(made.withColumnRenamed("part", "group").groupBy("group")).applyInPandas(down, UPPER), "uppers")
    return made


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    The proof is checked against the row as it is after tampering, which deletes the line ends of the text where the checksum of the id is even.
    """
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    changed = F.when(F.crc32(own.cast("binary")) % 2 == 0, F.translate(F.col(text_col), "\n", "")).otherwise(F.col(text_col))
    leaf, tampered = leaf_hash(*(F.col(c) for c in fields)), leaf_hash(*(changed if c == text_col else F.col(c) for c in fields))
    rows, parts, trees = placed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), leaf.alias("leaf"), F.when(changed != F.col(text_col), tampered).alias("tampered")))
    kind = docs.schema[id_col].dataType.simpleString()

    def leaves_of(t: pa.Table) -> Forest:
        tree, at, leaf, total = (t.column(c).to_pylist() for c in ("tree", "idx", "leaf", "total"))
        return Forest(trees).add(((a, 0, b), d, n) for a, b, d, n in zip(tree, at, leaf, total))

    schema = pa.schema([(c, pa.string() if c == "digest" else pa.int32() if c == "level" else pa.int64()) for c in ("part", "tree", "level", "idx", "total", "digest")])

    def up(key: tuple, t: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(_left_open(key[0].as_py(), leaves_of(t)), schema, preserve_index=False)

    def prove(t: pa.Table, above: pa.Table) -> pa.Table:
        forest = leaves_of(t)
        known = {(r["tree"], r["level"], r["idx"]): r for r in above.to_pylist()}
        tree, at, leaf, tampered = (t.column(c).to_pylist() for c in ("tree", "idx", "leaf", "tampered"))
        out: dict[str, list] = {c: [] for c in ("subroot", "root", "proof_sha256", "folded_root", "verified")}
        for k in range(len(leaf)):
            steps, subroot, key = forest.steps((tree[k], 0, at[k]))
            rest = known[key]
            steps += zip(rest["lefts"], rest["rights"])
            end = folded(tampered[k] or leaf[k], steps)
            for c, v in zip(out, (subroot or rest["subroot"], rest["root"], node_hash(*(x for s in steps for x in s)), end, end == rest["root"])):
                out[c].append(v)
        return pa.table([t.column("doc_id"), t.column("leaf"), *(pa.array(v, pa.bool_() if c == "verified" else pa.string()) for c, v in out.items())], names=["doc_id", "leaf", *out])

    rounds = reduced(rows.select("part", "tree", "idx", "leaf", "total").groupBy("part").applyInArrow(up, FOREST), parts, trees)
    both = rows.groupBy("part").cogroup(uppers(rounds, trees).groupBy("part"))
    return both.applyInArrow(prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
