"""Exact Jaccard join of n-gram sets by parity sketches.

Every distinct five-word run of a text flips one bit of a sketch, at its hash. The runs that two sets share cancel out, so the
Hamming distance of two sketches is at most the sets' symmetric difference, and sets with a Jaccard similarity of at least
`least` differ in at most (1 - least) / (1 + least) of the sum of their sizes. A sketch of half the length is the XOR of
its halves, so that sketches of any two sizes can be compared. Both facts are used:

* Candidates. The sketch of 2^64 bits, one for each hash, is cut into as many segments as the set's size band has (its power
  of two, so that a segment has one or two bits set). Differing runs touch at most so many segments, so by the pigeonhole principle
  one of the first segments in use, one more than may be touched, is equal in both sketches. Its fingerprint, the XOR of its
  runs' hashes, is a key. Sets that may have partners in the band below also have its keys. Where more than
  `KEYS` keys would be due, of sets of over 190 runs, KEYS are taken: each is untouched with a probability of 0.57 or more, and
  all are touched with one of less than 1e-17, as rare as equal hashes of unlike runs. Sets of fewer than `SINGLE` runs have segments of one run each.
* Filter. Sketches of two to four bits a run are compared before any sets are.

What is left is verified on the sets. Texts with equal sets are one from the start. Each set is compared with the first one of its
keys first, which connects most copies; then all pairs with a common key that are not in one component yet, likeliest first.
Keys that many unlike sets share are divided by their rarest runs (a prefix filter, as exact; runs that no two of these sets
have in common are left out by a filter of fixed size), and their pairs dealt to tasks in blocks. So components are those of all links; no pair that may connect two components is left out, and none is capped.

Defined results: null and empty texts have no runs, n_shingles 0, and are linked with nothing, not even with each other; texts of
fewer than five words are one run; repeated rows are linked; null ids count as larger than all others; an empty table gives
an empty result; other columns are ignored. Words are compared by 64 bits of their hash for n_shingles and keys, by 32 bits in sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeno.llm.common import components, lookup, only_ids, written, zipped
from lumeno.llm.ordermin import COUNTERS, ROWS, SIDE, WIDE, _joined, _mixed, _rooted
from lumeno.llm.wordhash import P1, P2, Words, blocks, mix, runs

K, LEAST, KEYS, SINGLE = 5, 80, 48, 64
#: Longer lists of candidates are dealt to so many slots.
LIST, SLOTS = 4096, 1024
#: Bits of the filter of shared runs, and how many of them are put together by one task.
SEEN, SLICE = 1 << 24, 1 << 18
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs in order, and where each text's begin, with the end; a text of fewer words is one run."""
    n = np.diff(first)
    made = np.where(n >= K, n - K + 1, 0)
    text = np.repeat(np.arange(len(n)), made)
    at = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + first[text]
    g = [runs(h, K)[at]]
    owner = [text]
    for k in range(1, K):
        few = np.flatnonzero(n == k)
        if len(few):
            g.append(mix(runs(h, k)[first[few]] + np.uint64(k)))
            owner.append(few)
    g, owner = np.concatenate(g), np.concatenate(owner)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        new = np.append(True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1]))
        g, owner = g[new], owner[new]
    return g, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])


def most_apart(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes."""
    return (100 - least) * (a + b) // (100 + least)


def keys(g: np.ndarray, begin: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each text's sketch segments, and the text of each."""
    n = np.diff(begin)
    band = np.where(n < SINGLE, 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64))
    larger = 100 * n // least  # the largest partner
    lowest = -(-least * n // 100)  # the smallest
    below = np.where(lowest < SINGLE, 0, np.floor(np.log2(np.maximum(lowest, 1))).astype(np.int64))
    found = [_band_keys(g, begin, np.flatnonzero(n > 0), band, most_apart(n, larger, least))]
    both = np.flatnonzero((n > 0) & (below != band))
    found.append(_band_keys(g, begin, both, below, most_apart(n, n, least)))
    return np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found])


def _band_keys(g: np.ndarray, begin: np.ndarray, texts: np.ndarray, band: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the first segments in use of the texts' sketches: one more than may be touched, KEYS at most."""
    n = (begin[1:] - begin[:-1])[texts]
    owner = np.repeat(np.arange(len(texts)), n)
    own = g[np.repeat(begin[texts] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    b = band[texts][owner]
    segment = np.where(b == 0, own, own >> (np.uint64(64) - np.maximum(b, 1).astype(np.uint64)))
    new = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])))
    print_ = np.bitwise_xor.reduceat(mix(own + np.uint64(P1)), new)
    key, owner = mix(print_ + segment[new] * np.uint64(P2) + b[new].astype(np.uint64)), owner[new]
    start = np.searchsorted(owner, np.arange(len(texts)))
    rank = np.arange(len(owner)) - start[owner]
    due = np.minimum(apart[texts] + 1, KEYS)
    kept = rank < due[owner]
    return key[kept], texts[owner[kept]]


def parity(g: np.ndarray) -> bytes:
    """The set's sketch: at least two bits a run, a power of two, 64 at least."""
    bits = max(64, 1 << (2 * max(len(g), 1) - 1).bit_length())
    odd = (np.bincount((g % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def halved(raw: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of so many bytes, larger ones by the XOR of their parts."""
    out = np.zeros((len(raw), size // 8), np.uint64)
    sizes = np.array([len(x) for x in raw])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        rows = np.frombuffer(b"".join([raw[k] for k in at]), np.uint64).reshape(len(at), n // size, size // 8)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """doc_id, digest (of the set), n_shingles, keys, profile (the parity sketch), words (32 bits of each word's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1).to_pylist()):
                words = Words([t.translate(_LOWER) for t in texts])
                h = words.hashes()
                g, begin = shingles(h, words.first)
                n = np.diff(begin)
                key, text = keys(g, begin, least)
                order = np.argsort(text, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[order].view(np.int64)))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(g * np.uint64(p)), dtype=np.uint64)]) for p in (P1, P2)]
                digest = [f"{a:016x}{b:016x}{c:x}" for a, b, c in zip(*((s[begin[1:]] - s[begin[:-1]]).tolist() for s in sums), n.tolist())]
                short = (h >> np.uint64(32)).astype(np.uint32)
                held = [short[a:b].tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
                bits = [parity(g[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(digest), pa.array(n), lists, pa.array(bits, pa.binary()), pa.array(held, pa.binary())], names=["doc_id", "digest", "n_shingles", "keys", "profile", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, digest string, n_shingles long, keys array<long>, profile binary, words binary")


def runs_of(raw: bytes) -> np.ndarray:
    """The distinct runs of a text given by its words."""
    h = mix(np.frombuffer(raw, np.uint32).astype(np.uint64))
    return shingles(h, np.array([0, len(h)]))[0]


def _of(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The facts of the pairs' sets: the others are dropped where they are read."""
    return only_ids(facts, pairs.select("a").union(pairs.select("b")), "rid", most=500_000)


def plausible(pairs: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches in facts (rid, n_shingles, profile) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (batch.column(c).to_pylist() for c in (2, 3))
            most = most_apart(batch.column(4).to_numpy(), batch.column(5).to_numpy(), least)
            size, ok = np.array([min(len(x), len(y)) for x, y in zip(p, q)], np.int64), np.zeros(len(p), bool)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                ok[at] = np.bitwise_count(np.bitwise_xor(*(halved([x[k] for k in at], n) for x in (p, q)))).sum(axis=1) <= most[at]
            kept = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    some = _of(facts, pairs)
    side = lambda a, p, n: some.select(F.col("rid").alias(a), F.col("profile").alias(p), F.col("n_shingles").alias(n))
    both = lookup(lookup(pairs, "b", side("b", "q", "m"), F.col("a")), "a", side("a", "p", "n"), F.col("b"))
    return both.where(100 * F.least("n", "m") >= least * F.greatest("n", "m")).select("a", "b", "p", "q", "n", "m").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """pairs (a, b) with linked and similarity, from the texts' whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def held(key: int, raw: pa.Scalar) -> np.ndarray:
            if key not in known:
                if len(known) > 64:
                    known.clear()
                known[key] = runs_of(raw.as_py())
            return known[key]

        for batch in batches:
            a, b, made = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for k in range(batch.num_rows):
                x, y = held(a[k], batch.column(2)[k]), held(b[k], batch.column(3)[k])
                common = len(np.intersect1d(x, y, assume_unique=True))
                made.append((100 * common >= least * (len(x) + len(y) - common), common / (len(x) + len(y) - common)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.bool_()), pa.array([s for _, s in made], pa.float64())], names=["a", "b", "linked", "similarity"])

    some = _of(facts, pairs)
    side = lambda a, w: some.select(F.col("rid").alias(a), F.col("words").alias(w))
    both = lookup(lookup(pairs, "b", side("b", "words_b"), F.col("a")), "a", side("a", "words_a"), F.col("b"))
    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long, linked boolean, similarity double")


def possible(rows: pa.Table, least: int) -> pa.Table:
    """a, root_a, root_b, slot, others: for a left set of any group (bucket, lb, rb) and a root of its right sets those that
    sizes and sketches don't rule out, likeliest first; more than LIST of them are dealt to slots."""
    rows = rows.sort_by([("bucket", "ascending"), ("lb", "ascending"), ("rb", "ascending"), ("side", "ascending"), ("n_shingles", "ascending")])
    bucket, lb, rb, n, rid, root = (rows.column(k).to_numpy() for k in ("bucket", "lb", "rb", "n_shingles", "rid", "root"))
    side, other = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("side", "other"))
    raw = rows.column("profile").to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])) + 1
    found: list[np.ndarray] = [np.zeros((5, 0), np.int64)]
    for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(rid)]):
        right = start + int(np.searchsorted(side[start:end], 1))
        at_size = {b: halved([x if len(x) >= b else bytes(b) for x in raw[start:end]], b) for b in np.unique(size[start:end]).tolist()}
        for i in range(start, right):
            j = np.arange(*(right + np.searchsorted(n[right:end], [-(-least * n[i] // 100), 100 * n[i] // least + 1])))
            j = j[(root[j] != root[i]) & (~other[j] | (rid[j] > rid[i]))]  # two sets on both sides are one pair
            apart = np.empty(len(j), np.int64)
            common = np.minimum(size[j], size[i])
            for b in np.unique(common).tolist():
                p, some = at_size[b], np.flatnonzero(common == b)
                apart[some] = np.bitwise_count(p[j[some] - start] ^ p[i - start]).sum(axis=1)
            ok = apart <= most_apart(n[j], n[i], least)
            j, apart = j[ok], apart[ok]
            found.append(np.stack([np.full(len(j), rid[i]), np.full(len(j), root[i]), root[j], apart, rid[j]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)  # in order; the sets of several buckets once
    new = np.flatnonzero((pairs[:3, 1:] != pairs[:3, :-1]).any(axis=0)) + 1
    sizes = np.diff(np.concatenate([[0], new, [pairs.shape[1]]])) if pairs.shape[1] else np.zeros(0, np.int64)
    slot = np.where(np.repeat(sizes, sizes) > LIST, 1 + pairs[4] % SLOTS, 0)
    order = np.lexsort((np.arange(len(slot)), slot, np.repeat(np.arange(len(sizes)), sizes)))
    pairs, slot = pairs[:, order], slot[order]
    at = np.flatnonzero(np.concatenate([[True], (pairs[:3, 1:] != pairs[:3, :-1]).any(axis=0) | (slot[1:] != slot[:-1])]))[: len(slot)]
    ends = pa.array(np.append(at, len(slot)), pa.int32())
    return pa.table([*(pa.array(c[at]) for c in (*pairs[:3], slot)), pa.ListArray.from_arrays(ends, pa.array(pairs[4]))], names=["a", "root_a", "root_b", "slot", "others"])


def _place(g: np.ndarray) -> np.ndarray:
    """The bit of each run in the filter of shared runs."""
    return (mix(g + np.uint64(P2)) % np.uint64(SEEN)).astype(np.int64)


def shared_runs(texts: DataFrame) -> np.ndarray:
    """SEEN bits, packed: those of the runs that two or more of the texts (words) have. Other runs may share a bit of these, which loses none.

    Each task reports for each slice of the filter which bits it has seen once and more often, so its reports don't grow with its rows.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(SEEN, bool), np.zeros(SEEN, bool)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                at = np.sort(_place(runs_of(raw)))
                more[at[1:][at[1:] == at[:-1]]] = True
                more[at[once[at]]] = True
                once[at] = True
        used = np.flatnonzero(once.reshape(-1, SLICE).any(axis=1)).tolist()
        bits = lambda x: pa.array([np.packbits(x[k * SLICE : (k + 1) * SLICE], bitorder="little").tobytes() for k in used], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), bits(once), bits(more)], names=["slice", "once", "more"])

    def merge(rows: pa.Table) -> pa.Table:
        once, more = (np.zeros(SLICE // 8, np.uint8) for _ in range(2))
        for a, b in zip(rows["once"], rows["more"]):
            a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
            more |= b | (once & a)
            once |= a
        return pa.table([rows["slice"][:1], pa.array([more.tobytes()], pa.binary())], names=["slice", "more"])

    made = texts.select("words").mapInArrow(report, "slice int, once binary, more binary").groupBy("slice").applyInArrow(merge, "slice int, more binary")
    bits = np.zeros((SEEN // SLICE, SLICE // 8), np.uint8)
    for r in made.toLocalIterator():  # SEEN bits at most
        bits[r["slice"]] = np.frombuffer(r["more"], np.uint8)
    return bits.ravel()


def prefixes(hot: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """bucket (a run), rid, root of the sets in hot (rid, root): the rarest of a set's runs, one more than two linked sets may differ in on one side.

    Of these only the runs that another set has as well: no others are common to two sets.

    Rarity is by counters of fixed number over the runs of these sets, of which each task reports its largest; any order that all sets agree on is exact.
    """
    texts = written(_of(facts, hot.select(F.col("rid").alias("a"), F.col("rid").alias("b"))).select("rid", "words").join(hot, "rid"), "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held += np.bincount((runs_of(raw) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.argpartition(held, -LIST)[-LIST:]
        at = at[held[at] > 1]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["slot", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for r in texts.select("words").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # COUNTERS rows at most
        counts[r["slot"]] = r["n"]
    shared = hot.sparkSession.sparkContext.broadcast((counts, shared_runs(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value
        for batch in batches:
            rids, roots, parts = [], [], []
            for rid, raw, root in zip(*(batch.column(k).to_pylist() for k in range(3))):
                g = runs_of(raw)
                order = np.lexsort((g, counts[(g % np.uint64(COUNTERS)).astype(np.int64)]))
                some = g[order[: len(g) - math.ceil(least * len(g) / 100) + 1]]
                at = _place(some)
                some = some[seen[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
                rids.append(np.full(len(some), rid))
                roots.append(np.full(len(some), root))
                parts.append(some)
            if rids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(rids)), pa.array(np.concatenate(roots))], names=["bucket", "rid", "root"])

    return texts.select("rid", "words", "root").mapInArrow(run, "bucket long, rid long, root long")


def apart(active: DataFrame, roots: DataFrame, facts: DataFrame, least: int) -> DataFrame:
    """a, root_a, root_b, slot, others: sets with a common key that aren't in one component yet and may be linked.

    Sets outside a key's largest component are the left side, all its sets the right one; work is the product of both.
    """
    placed = written(_rooted(active.select("bucket", "rid"), roots, "rid", "root"), "placed")
    mixed = _mixed(placed, 3)  # a key of two sets has been compared
    rows = lookup(placed, "bucket", mixed, F.col("rid"))
    if not mixed.where(F.col("others") > SIDE).isEmpty():
        hot = written(rows.where(F.col("others") > SIDE).select("bucket", "rid", "root"), "hot")
        split = written(prefixes(hot.select("rid", "root").distinct(), facts, least), "split")
        rows = rows.where(F.col("others") <= SIDE).unionByName(lookup(split, "bucket", _mixed(split, 2), F.col("rid")))
    rows = rows.withColumns({"other": F.col("root") != F.col("major"), "lefts": F.ceil(F.col("others") / SIDE).cast("int"), "rights": F.ceil(F.col("n") / WIDE).cast("int")})
    own, every = lambda c: F.pmod(F.xxhash64("rid"), F.col(c)).cast("int"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = F.when(F.col("other"), F.transform(every("rights"), lambda k: F.struct(F.lit(0).alias("side"), own("lefts").alias("lb"), k.alias("rb"))))
    right = F.transform(every("lefts"), lambda k: F.struct(F.lit(1).alias("side"), k.alias("lb"), own("rights").alias("rb")))
    sides = rows.select("bucket", "rid", "root", "other", F.explode(F.when(F.col("other"), F.concat(left, right)).otherwise(right)).alias("x"))
    sides = written(sides.select("bucket", "rid", "root", "other", "x.*"), "sides")
    full = sides.join(facts.select("rid", "n_shingles", "profile"), "rid")
    dealt = full.withColumn("part", F.pmod(F.xxhash64("bucket", "lb", "rb"), F.lit(sides.count() // ROWS + 8)))
    return dealt.groupBy("part").applyInArrow(lambda t: possible(t, least), "a long, root_a long, root_b long, slot long, others array<long>")


def links(active: DataFrame, facts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """a, b, similarity of links that connect all linked sets, and node, root of their components."""

    def checked(pairs: DataFrame) -> DataFrame:
        return written(verify(written(plausible(written(pairs, "pairs"), facts, least), "pairs"), facts, least), "checked")

    done = checked(active.where("rid <> head").groupBy("rid").agg(F.min("head").alias("head")).select(F.col("head").alias("a"), F.col("rid").alias("b")))
    found = done.where("linked")
    roots = components(found.select("a", "b"))
    rest = _rooted(_rooted(active.where("rid <> head").select("rid", "head"), roots, "rid", "ra"), roots, "head", "rb", F.col("rid"))
    rest = rest.where("ra <> rb").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")
    more = checked(rest)
    done = done.unionByName(more)
    found, roots = _joined(found, more.where("linked"), roots)
    todo = written(apart(active, roots, facts, least), "todo")
    pair = lambda c: (F.least("a", c).alias("a"), F.greatest("a", c).alias("b"))
    # One link joins two components, so the likeliest partner of each set and component is tried before all others.
    first = todo.select(*pair(F.get("others", 0))).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")
    more = written(verify(written(first, "pairs"), facts, least), "checked")
    done = done.unionByName(more)
    found, roots = _joined(found, more.where("linked"), roots)
    # Sets that share several keys are listed by several tasks; their lists are merged, long ones in slots.
    lists = todo.groupBy("a", "root_a", "root_b", "slot").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    rest = _rooted(_rooted(lists, roots, "root_a", "ra"), roots, "root_b", "rb").where("ra <> rb")
    rest = rest.select("a", F.explode("others").alias("c")).select(*pair(F.col("c"))).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")
    more = written(verify(written(rest, "pairs"), facts, least), "checked")
    found, roots = _joined(found, more.where("linked"), roots)
    return found.select("a", "b", "similarity"), roots


def join(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links reach) for each row; links have 100 * intersection >= least * union."""
    if not 50 <= least <= 100:
        raise ValueError("least is a percentage of at least 50")
    made = zipped(sketch(docs, id_col, text_col, least).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    some = made.where("n_shingles > 0")
    firsts = written(some.groupBy("digest").agg(F.min("rid").alias("first"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "firsts")
    again = lookup(some.select("digest", "rid"), "digest", firsts.where("copies > 1").select("digest", "first"), F.col("rid")).where("rid <> first").select("rid")
    facts = only_ids(some, written(again, "copies"), "rid", "left_anti")
    places = facts.select("rid", F.explode(F.array_distinct("keys")).alias("bucket"))
    heads = places.groupBy("bucket").agg(F.min("rid").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    active = written(lookup(places, "bucket", heads, F.col("rid")), "keys")
    _, roots = links(active, facts, least)
    known = written(_rooted(firsts.select("digest", "least_id", F.col("first").alias("node")), roots.select(F.col("node"), "root"), "node", "root"), "known")
    named = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    full = lookup(known.select("digest", "root"), "root", named, F.col("digest")).drop("root")
    joined = lookup(some.select("doc_id", "n_shingles", "digest"), "digest", full, F.col("doc_id")).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(made.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
