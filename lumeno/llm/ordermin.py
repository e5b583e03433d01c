"""Near duplicates by Order MinHash (Marcais et al. 2019), verified by banded alignment.

A text's five-word runs are labelled with their occurrence. Each of `BANDS` hash functions picks the `PICKS` least of them,
and their hashes in text order make a band's key: texts share it if these runs agree and stand in the same order. Texts
that share a key are candidates. First each is compared with the first text of its buckets, which connects most copies. Then
every pair of a bucket whose texts are not in one class yet is a candidate, linked texts included. Pairs whose lengths or
word profiles rule a link out are never aligned; that bound is exact: an edit moves at most one word out of the
profile's bins and one into another. All others are aligned, so the classes are those that all pairs with a common key give.
Nothing is capped or sampled.

A bucket with more than `SIDE` texts outside its largest class, as a passage in very many unlike texts makes it, is divided by
an exact prefix filter first: texts within the similarity share so many words that, in any fixed order of words, both have one
of their first (1 - least) in common; the order is by rarity in these texts. Only texts that share such a word too are
compared. Buckets are cut into blocks, whose pairs are dealt to tasks.

A link is an alignment of both texts' words within a band whose edits (words inserted, deleted or replaced) are at most
1 - least of the longer text: a similarity of at least `least`. Scattered edits of a fifth of the words leave 0.8^5 of the
five-word runs, a Jaccard similarity of 0.2; such texts share a band's key with a probability of 0.95. Texts of up to
`SHORT` words also have each of their three-word runs as a key, and those of up to nine words each of their subsequences
without one word: by the pigeonhole principle all links between such texts share one at the default threshold. Classes are the
connected components of the links. Texts with equal words are one from the start and are compared as one. Words are
compared by 32 bits of their hash.

Defined results: null and empty texts have no words and are copies of each other; texts of fewer than five words link only
to copies; null ids are kept, and count as larger than all others; repeated rows are copies; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumeno.llm.common import components, lookup, matched, only_ids, written, zipped
from lumeno.llm.wordhash import P1, P2, Words, blocks, mix, powers, runs

K, BANDS, PICKS, LEAST, SHORT = 5, 80, 2, 0.8, 24
#: Bins of profiles (a text has the first that are twice its words or more), texts in a block of a large bucket's left and right side, rows in a group of blocks, and counters of word frequencies.
BINS, SIDE, WIDE, ROWS, COUNTERS = (128, 512, 2048, 8192), 512, 4096, 20_000, 1 << 20
#: Longer lists of candidates are dealt to so many slots.
LIST, SLOTS = 4096, 1024
_MULTIPLIERS = (np.random.default_rng(20).integers(0, 1 << 63, BANDS, np.uint64) << np.uint64(1)) | np.uint64(1)


def _digest(h: np.ndarray, first: np.ndarray) -> list[str]:
    """128 bits of each text's word sequence, as hex."""
    out = []
    for base in (P1, P2):
        up = powers(base, len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        down = powers(pow(base, -1, 1 << 64), len(h) + 1)
        out.append(mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64)))
    return [f"{a:016x}{b:016x}" for a, b in zip(out[0].tolist(), out[1].tolist())]


def labelled_runs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' labelled runs of K words, and where each text's begin, with the end."""
    all_runs, n = runs(h, K), np.maximum(np.diff(first) - K + 1, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    g, text = all_runs[at], np.repeat(np.arange(len(n)), n)
    key = mix(g + text.astype(np.uint64) * np.uint64(P2))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(key) else np.zeros(0, np.int64)
    occurrence = np.zeros(len(key), np.uint64)
    occurrence[order] = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return mix(g + occurrence * np.uint64(P1)), begin


def band_keys(g: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One key for each text and band; 0 where a text has no runs."""
    n = np.diff(begin)
    text = np.repeat(np.arange(len(n)), n)
    share = np.minimum(1.0, 9.0 / np.maximum(n, 1))
    limit = np.where(share < 1, np.minimum(share, 0.999999) * 2.0**64, 0).astype(np.uint64)
    limit[share >= 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
    limits, made = np.repeat(limit, n), np.zeros((len(n), BANDS), np.uint64)
    p = powers(P2, PICKS + 1)
    for b in range(BANDS):
        x = g * _MULTIPLIERS[b]
        idx = np.flatnonzero(x <= limits)
        few = np.flatnonzero(np.bincount(text[idx], minlength=len(n)) < np.minimum(n, PICKS))
        if len(few):
            idx = np.union1d(idx, np.concatenate([np.arange(begin[t], begin[t + 1]) for t in few]))
        order = np.lexsort((x[idx], text[idx]))
        own = text[idx][order]
        start = np.searchsorted(own, np.arange(len(n)))
        sel = np.sort(idx[order[np.arange(len(own)) - start[own] < PICKS]])
        own = text[sel]
        start = np.searchsorted(own, np.arange(len(n)))
        sums = np.zeros(len(n), np.uint64)
        np.add.at(sums, own, g[sel] * p[np.arange(len(own)) - start[own]])
        made[:, b] = mix(sums + np.uint64(b))
    made[n == 0] = 0
    return made


def short_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of short texts' three-word runs and subsequences without one word (and the whole), and the text of each."""
    n = np.diff(first)
    made = np.where(n <= SHORT, np.maximum(n - 2, 0), 0)
    text = np.repeat(np.arange(len(n)), made)
    at = np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made) + first[text]
    keys, texts = [mix(runs(h, 3)[at] + np.uint64(3))], [text]
    up = powers(P2, 10)
    for t in np.flatnonzero((n >= 4) & (n <= 9)):
        own, k = h[first[t] : first[t + 1]], int(n[t])
        less = np.array([np.delete(own, i) for i in range(k)]) * up[: k - 1]
        keys.append(mix(np.append(less.sum(axis=1, dtype=np.uint64), (own * up[:k]).sum(dtype=np.uint64)) + np.uint64(1)))
        texts.append(np.full(k + 1, t))
    return np.concatenate(keys), np.concatenate(texts)


def profiles(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each text how many words fall into each bin, 3 at most, in two bits; longer texts have more bins, of which those of
    shorter ones are sums."""
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        bins = BINS[bisect.bisect_left(BINS[:-1], 2 * (hi - lo))]
        n = np.minimum(np.bincount((h[lo:hi] % np.uint64(bins)).astype(np.int64), minlength=bins), 3).astype(np.uint8)
        out.append((n[::4] | n[1::4] << 2 | n[2::4] << 4 | n[3::4] << 6).tobytes())
    return out


def folded(raw: list[bytes], bins: int) -> np.ndarray:
    """Profiles as rows of so many bins, equal to those made with that number: sums are cut off at 3 as well."""
    out = np.zeros((len(raw), bins), np.int16)
    size = np.array([4 * len(x) for x in raw])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        packed = np.frombuffer(b"".join([raw[k] for k in at]), np.uint8)
        out[at] = np.stack([packed >> k & 3 for k in (0, 2, 4, 6)], axis=1).reshape(len(at), n // bins, bins).sum(axis=1, dtype=np.int16)
    return np.minimum(out, 3)


def least_edits(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The fewest edits that rows of profiles leave possible: the words of either that have no counterpart."""
    d = p - q
    return np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, n_words, the keys of its bands and short runs, the profile, and 32 bits of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1).to_pylist()):
                words = Words(texts)
                h = words.hashes()
                keys = band_keys(*labelled_runs(h, words.first))
                more, text = short_keys(h, words.first)
                own = np.concatenate([np.repeat(np.arange(len(texts)), BANDS), text])
                flat = np.concatenate([keys.ravel(), more])
                own, flat = own[flat != 0], flat[flat != 0]
                flat = flat[np.argsort(own, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
                short = (h >> np.uint64(32)).astype(np.uint32)
                held = [short[a:b].tobytes() for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
                cols = [pa.array(_digest(h, words.first)), pa.array(words.counts.astype(np.int64)), lists, pa.array(profiles(h, words.first), pa.binary()), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *cols], names=["doc_id", "digest", "n_words", "keys", "profile", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, digest string, n_words long, keys array<long>, profile binary, words binary")


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if at most `most`, else most + 1: bit-parallel along the diagonal (Hyyro 2003), in a band of 2 * most + 1."""
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)  # a: down the band, b: column by column
    if m - n > most:
        return most + 1
    asked, most = most, min(most, m)
    width = 2 * most + 1
    mask, where = (1 << width) - 1, {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    # Bit k of the band at column j is row j - most + k. Above row 1 lies the border, with vertical differences of 0 bits.
    vp, vn = (mask >> most) << most, 0
    distance = most
    # Until the band's last row is that of the last word, the distance follows the diagonal; then it follows that word's row.
    top = 1 << (width - 1)
    level, row = top >> 1, most
    for j, w in enumerate(b):
        eq = where.get(w, 0)
        shift = j - most
        eq = (eq >> shift if shift >= 0 else eq << -shift) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if row < m:
            if not d0 & top:
                distance += 1
        else:
            if hp & level:
                distance += 1
            if hn & level:
                distance -= 1
            level >>= 1
        row += 1
        if distance > 2 * most + 1:
            return asked + 1
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
    return min(distance, asked + 1)


def linked(a: np.ndarray, b: np.ndarray, runs_a: np.ndarray, runs_b: np.ndarray, least: float) -> tuple[bool, float]:
    """Whether two texts, as hashes of their words and of their labelled runs, are near duplicates, and their similarity (0 if they aren't)."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))).sum()
    if longer - common > most:  # the distance is no less than the words that have no counterpart
        return False, 0.0
    alone = max(len(runs_a), len(runs_b)) - len(np.intersect1d(runs_a, runs_b, assume_unique=True))
    x, y = a.tolist(), b.tolist()
    for band in sorted({min(most, alone // 2 + 8), most}):  # most links need a narrow band only
        d = banded_distance(x, y, band)
        if d <= band:
            return True, 1 - d / longer
    return False, 0.0


def _most(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """How many edits texts of these lengths may have."""
    return ((1 - least) * np.maximum(a, b) + 1e-9).astype(np.int64)


def _of(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The facts of the pairs' texts: the others are dropped where they are read, not shuffled."""
    return only_ids(facts, pairs.select("a").union(pairs.select("b")), "rid", most=500_000)


def plausible(pairs: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that the lengths and profiles in facts (rid, n_words, profile) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (batch.column(c).to_pylist() for c in (2, 3))
            most = _most(batch.column(4).to_numpy(), batch.column(5).to_numpy(), least)
            bins, ok = np.array([4 * min(len(x), len(y)) for x, y in zip(p, q)], np.int64), np.zeros(len(p), bool)
            for n in np.unique(bins).tolist():
                at = np.flatnonzero(bins == n)
                ok[at] = least_edits(*(folded([x[k] for k in at], n) for x in (p, q))) <= most[at]
            kept = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    some = _of(facts.select("rid", "profile", "n_words"), pairs)
    with_b = pairs.join(some.select(F.col("rid").alias("b"), F.col("profile").alias("q"), F.col("n_words").alias("m")), "b")
    both = lookup(with_b, "a", some.select(F.col("rid").alias("a"), F.col("profile").alias("p"), F.col("n_words").alias("n")), F.col("b"))
    near = F.abs(F.col("n") - F.col("m")) <= F.floor((1 - least) * F.greatest("n", "m") + 1e-9)
    return both.where(near).select("a", "b", "p", "q", "n", "m").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) of rids with linked and similarity; facts has the words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}

        def words(key: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
            if key not in known:
                if len(known) > 64:
                    known.clear()
                h = mix(np.frombuffer(raw, np.uint32).astype(np.uint64))
                known[key] = h, labelled_runs(h, np.array([0, len(h)]))[0]
            return known[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [linked(x[0], y[0], x[1], y[1], least) for k in range(batch.num_rows) for x, y in [(words(a[k], batch.column(2)[k].as_py()), words(b[k], batch.column(3)[k].as_py()))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.bool_()), pa.array([s for _, s in made], pa.float64())], names=["a", "b", "linked", "similarity"])

    some = _of(facts.select("rid", "words"), pairs)
    with_b = pairs.join(some.select(F.col("rid").alias("b"), F.col("words").alias("words_b")), "b")
    both = lookup(with_b, "a", some.select(F.col("rid").alias("a"), F.col("words").alias("words_a")), F.col("b"))
    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long, linked boolean, similarity double")


def possible(rows: pa.Table, least: float) -> pa.Table:
    """a, root_a, root_b, slot, others: for a left text of any group (bucket, lb, rb) and a root of its right texts those that
    lengths and profiles don't rule out, likeliest first; more than LIST of them are dealt to slots."""
    rows = rows.sort_by([("bucket", "ascending"), ("lb", "ascending"), ("rb", "ascending"), ("side", "ascending"), ("n_words", "ascending")])
    bucket, lb, rb, n, rid, root = (rows.column(k).to_numpy() for k in ("bucket", "lb", "rb", "n_words", "rid", "root"))
    side, other = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("side", "other"))
    raw = rows.column("profile").to_pylist()
    size = np.array([4 * len(x) for x in raw])
    cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])) + 1
    found: list[np.ndarray] = [np.zeros((5, 0), np.int64)]
    for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(rid)]):
        right = start + int(np.searchsorted(side[start:end], 1))
        at_bins = {b: folded([x if 4 * len(x) >= b else bytes(b // 4) for x in raw[start:end]], b) for b in np.unique(size[start:end]).tolist()}
        for i in range(start, right):
            j = np.arange(*(right + np.searchsorted(n[right:end], [n[i] * least - 1e-6, n[i] / least + 1e-6])))
            j = j[(root[j] != root[i]) & (~other[j] | (rid[j] > rid[i]))]  # two texts on both sides are one pair
            apart = np.empty(len(j), np.int64)
            bins = np.minimum(size[j], size[i])
            for b in np.unique(bins).tolist():
                p, some = at_bins[b], np.flatnonzero(bins == b)
                apart[some] = least_edits(p[j[some] - start], p[i - start : i - start + 1])
            ok = apart <= _most(n[j], n[i], least)
            j, apart = j[ok], apart[ok]
            found.append(np.stack([np.full(len(j), rid[i]), np.full(len(j), root[i]), root[j], apart, rid[j]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)  # in order; the texts of several buckets once
    new = np.flatnonzero((pairs[:3, 1:] != pairs[:3, :-1]).any(axis=0)) + 1
    sizes = np.diff(np.concatenate([[0], new, [pairs.shape[1]]])) if pairs.shape[1] else np.zeros(0, np.int64)
    slot = np.where(np.repeat(sizes, sizes) > LIST, 1 + pairs[4] % SLOTS, 0)
    order = np.lexsort((np.arange(len(slot)), slot, np.repeat(np.arange(len(sizes)), sizes)))
    pairs, slot = pairs[:, order], slot[order]
    at = np.flatnonzero(np.concatenate([[True], (pairs[:3, 1:] != pairs[:3, :-1]).any(axis=0) | (slot[1:] != slot[:-1])]))[: len(slot)]
    ends = pa.array(np.append(at, len(slot)), pa.int32())
    return pa.table([*(pa.array(c[at]) for c in (*pairs[:3], slot)), pa.ListArray.from_arrays(ends, pa.array(pairs[4]))], names=["a", "root_a", "root_b", "slot", "others"])


def prefixes(hot: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """rid, part of the texts in hot (rid): the rarest of a text's words, so many that two texts within the similarity share one.

    Words are told apart by their occurrence. Rarity is by counters of fixed number over the words of these texts; any order
    that all texts agree on is exact. A word that only one text has is shared by none, so it is left out; it counts in the length.
    """
    texts = only_ids(facts.select("rid", "words"), hot.select("rid"), "rid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                np.add.at(held, np.unique(labelled_words(np.frombuffer(raw, np.uint32).astype(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["slot", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    slots = texts.select("words").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    shared = hot.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, parts = [], []
            for rid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                label = labelled_words(np.frombuffer(raw, np.uint32).astype(np.uint64))
                held = shared.value[(label % np.uint64(COUNTERS)).astype(np.int64)]
                order = np.lexsort((label, held))[: len(label) - math.ceil(least * len(label) - 1e-6) + 1]
                some = label[order[held[order] > 1]]
                rids.append(np.full(len(some), rid))
                parts.append(some)
            if rids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rids)), pa.array(np.concatenate(parts).view(np.int64))], names=["rid", "part"])

    return texts.mapInArrow(run, "rid long, part long")


def labelled_words(w: np.ndarray) -> np.ndarray:
    """Hashes of a text's words with their occurrence."""
    order = np.argsort(w, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], w[order][1:] != w[order][:-1]])) if len(w) else np.zeros(0, np.int64)
    occurrence = np.zeros(len(w), np.uint64)
    occurrence[order] = np.arange(len(w)) - np.repeat(new, np.diff(np.append(new, len(w))))
    return mix(w + occurrence * np.uint64(P1))


def _rooted(rows: DataFrame, roots: DataFrame, col: str, name: str, salt: Column | None = None) -> DataFrame:
    """rows with the root of col as name: itself where it has no links. With salt col may be hot."""
    named = roots.select(F.col("node").alias(col), F.col("root").alias(name))
    made = rows.join(named, col, "left") if salt is None else lookup(rows, col, named, salt, "left")
    return made.withColumn(name, F.coalesce(name, col))


def _mixed(placed: DataFrame, least_n: int) -> DataFrame:
    """bucket, n, major (the root of most of its texts), others (texts of other roots) of the buckets that hold several roots.

    Of buckets that hold the same texts, told by 128 bits of these, one is left, since all have the same pairs.
    """
    same = {"x": F.xxhash64("rid"), "y": F.xxhash64("rid", F.lit(1))}
    per = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), *[F.bit_xor(h).alias(k) for k, h in same.items()])
    made = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("major"), (F.sum("n") - F.max("n")).alias("others"), *[F.bit_xor(k).alias(k) for k in same])
    return written(made.where((F.col("others") > 0) & (F.col("n") >= least_n)).dropDuplicates(["n", *same]).drop(*same), "mixed")


def apart(active: DataFrame, roots: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """a, root_a, root_b, slot, others: texts with a common bucket that aren't in one class yet and may be links.

    Texts outside a bucket's largest class are the left side, all its texts the right one; work is the product of both.
    """
    placed = written(_rooted(active.select("bucket", "rid"), roots, "rid", "root"), "placed")
    mixed = _mixed(placed, 3)  # a bucket of two has been compared
    rows = lookup(placed, "bucket", mixed, F.col("rid"))
    if not mixed.where(F.col("others") > SIDE).isEmpty():
        hot = written(rows.where(F.col("others") > SIDE).select("bucket", "rid", "root"), "hot")
        split = hot.join(prefixes(hot.select("rid").distinct(), facts, least), "rid").select(F.xxhash64("bucket", "part").alias("bucket"), "rid", "root")
        split = written(split, "split")
        rows = rows.where(F.col("others") <= SIDE).unionByName(lookup(split, "bucket", _mixed(split, 2), F.col("rid")))
    rows = rows.withColumns({"other": F.col("root") != F.col("major"), "lefts": F.ceil(F.col("others") / SIDE).cast("int"), "rights": F.ceil(F.col("n") / WIDE).cast("int")})
    own, every = lambda c: F.pmod(F.xxhash64("rid"), F.col(c)).cast("int"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = F.when(F.col("other"), F.transform(every("rights"), lambda k: F.struct(F.lit(0).alias("side"), own("lefts").alias("lb"), k.alias("rb"))))
    right = F.transform(every("lefts"), lambda k: F.struct(F.lit(1).alias("side"), k.alias("lb"), own("rights").alias("rb")))
    rows = written(rows.select("bucket", "rid", "root", "other", "lefts", "rights"), "rows")
    n_sides = rows.agg(F.sum(F.col("lefts") + F.when(F.col("other"), F.col("rights")).otherwise(0))).first()[0] or 0
    # Facts are joined before rows are dealt to blocks, which they go to anyway.
    full = rows.join(only_ids(facts.select("rid", "n_words", "profile"), rows.select("rid"), "rid", most=500_000), "rid")
    sides = full.select("bucket", "rid", "root", "other", "n_words", "profile", F.explode(F.when(F.col("other"), F.concat(left, right)).otherwise(right)).alias("x"))
    sides = sides.select("bucket", "rid", "root", "other", "n_words", "profile", "x.*")
    dealt = sides.withColumn("part", F.pmod(F.xxhash64("bucket", "lb", "rb"), F.lit(n_sides // ROWS + 8)))
    return dealt.groupBy("part").applyInArrow(lambda t: possible(t, least), "a long, root_a long, root_b long, slot long, others array<long>")


def classes(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), class_size, n_links, n_words for each row.

    n_links is a lower bound: the links to other texts that were verified. Which pairs of one class are verified depends on
    the order of rows, the classes don't."""
    made = zipped(sketch(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    firsts = made.groupBy("digest").agg(F.min("rid").alias("first"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    firsts = written(firsts, "firsts")
    again = lookup(made.select("digest", "rid"), "digest", firsts.where("copies > 1").select("digest", "first"), F.col("rid")).where("rid <> first").select("rid")
    facts = only_ids(made, written(again, "copies"), "rid", "left_anti")
    places = facts.select("rid", F.explode(F.array_distinct("keys")).alias("bucket"))
    heads = places.groupBy("bucket").agg(F.min("rid").alias("head"), F.count("*").alias("n")).where("n > 1")
    active = written(matched(places, "bucket", written(heads, "heads")), "buckets")
    return _labelled(made.select("doc_id", "digest", "n_words"), firsts, *_links(active, facts, least))


def _links(active: DataFrame, facts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """a, b, similarity of the links, and node, root of their components: first the links between texts and the first of their buckets, then between all others of a bucket that are still apart."""

    def checked(pairs: DataFrame) -> DataFrame:
        return written(verify(written(plausible(written(pairs, "pairs"), facts, least), "pairs"), facts, least), "checked")

    # A group of copies mostly has one first text, so one pair for each text connects most of them.
    one = active.where("rid <> head").groupBy("rid").agg(F.min("head").alias("head")).select(F.col("head").alias("a"), F.col("rid").alias("b"))
    made = checked(one)
    links, roots = made.where("linked"), components(made.where("linked").select("a", "b"))
    rest = _rooted(active.where("rid <> head").select("rid", "head"), roots, "rid", "ra")
    rest = _rooted(rest, roots, "head", "rb", F.col("rid")).where("ra <> rb").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    more = checked(rest.join(made.select("a", "b"), ["a", "b"], "left_anti"))
    links, roots = _joined(links, more.where("linked"), roots)
    done = made.select("a", "b").unionByName(more.select("a", "b"))
    todo = written(apart(active, roots, facts, least), "todo")
    pair = lambda b: (F.least("a", b).alias("a"), F.greatest("a", b).alias("b"))
    # One link joins two classes, so the likeliest partner of each text and class is tried before all others.
    first = todo.select(*pair(F.get("others", 0))).distinct().join(done, ["a", "b"], "left_anti")
    more = written(verify(written(first, "pairs"), facts, least), "checked")
    links, roots = _joined(links, more.where("linked"), roots)
    # Texts that share several buckets are listed by several tasks; their lists are merged, long ones in slots.
    lists = todo.groupBy("a", "root_a", "root_b", "slot").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    rest = _rooted(_rooted(lists, roots, "root_a", "ra"), roots, "root_b", "rb").where("ra <> rb")
    rest = rest.select("a", F.explode("others").alias("c")).select(*pair(F.col("c"))).distinct()
    rest = rest.join(done.unionByName(more.select("a", "b")), ["a", "b"], "left_anti")
    more = written(verify(written(rest, "pairs"), facts, least), "checked")
    links, roots = _joined(links, more.where("linked"), roots)
    return links.select("a", "b", "similarity"), roots


def _joined(links: DataFrame, more: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sets of links and the roots of all; these change only if there are more."""
    if more.isEmpty():
        return links, roots
    both = links.unionByName(more)
    return both, components(both.select("a", "b"))


def _labelled(made: DataFrame, firsts: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("first")).union(links.select("b")).groupBy("first").agg(F.count("*").alias("n_links"))
    known = firsts.join(roots.withColumnRenamed("node", "first"), "first", "left").join(ends, "first", "left").select("digest", F.coalesce("root", "first").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "least_id", "copies")
    known = written(known, "known")
    groups = known.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    full = lookup(known.select("digest", "root", "n_links"), "root", groups, F.col("digest")).drop("root")
    return lookup(made, "digest", full, F.col("doc_id")).select("doc_id", "class_id", "class_size", "n_links", "n_words")


def deduplicate(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, of each class the row with the least id. Ids that aren't unique are replaced by row numbers for the comparison."""
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():
        numbered = written(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_rid")), "numbered")
        made = classes(numbered, least, "_rid", "_text")
        return only_ids(numbered, made.where("doc_id <> class_id").select("doc_id"), "_rid", "left_anti").select("_row.*")
    made = written(classes(docs, least, id_col, text_col).where("NOT (doc_id <=> class_id)").select("doc_id"), "dropped")
    return only_ids(docs, made, id_col, "left_anti")
