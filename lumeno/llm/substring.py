"""Repeated passages: matching statistics against suffix automata of reference shards.

A window is `width` consecutive words of a text. Words in a window whose words also start somewhere else are removed.

Which windows may repeat is found by hashes first. Of each window the least hash of its 18-word runs is an anchor, so equal
windows have equal anchors; anchors with more than one occurrence are joined back, and only the windows they stand for are
hashed and counted. Of each group of equal windows the one with the least place is the reference. The references' passages are dealt to
shards of about `SHARD` words by their text, and each shard gets a suffix automaton over whole words. All other windows are cut into
segments, sent to the shard of their reference, and streamed through its automaton: where the length of the match is at least
`width`, a window is confirmed, word by word, whatever the hashes said. A shard that gets much to read is loaded by several
tasks, so memory is bounded by the shard and work by the segments. An automaton is rebuilt from its passages wherever it is needed,
so a lost executor costs its own tasks only.

Texts that equal another one are removed whole if they have `width` words; each different text is read once.

Defined results: null and empty texts have no words and keep none; texts of fewer words than `width` are kept; null ids are
kept; repeated rows are copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumeno.llm.common import lookup, matched, only_ids, written
from lumeno.llm.wordhash import P1, P2, Words, blocks, runs

WIDTH, SHARD, PER_TASK = 35, 100_000, 1_500_000
_FLAT = bytes(32 if c in b"\t\n\x0b\x0c\r" else c for c in range(256))
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Places of references that go to one shard together.
_BLOCK = 1 << 14


class Automaton:
    """Suffix automaton of word sequences: next states, suffix links and longest lengths, as lists."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
            else:
                cur, p = -1, last
            if length[q] == length[p] + 1:
                target = q
            else:
                target = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = target
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = target
                    p = link[p]
            if cur >= 0:
                link[cur] = target
                last = cur
            else:
                last = target

    def ends(self, words: list[bytes], width: int) -> list[int]:
        """Positions where the longest match that ends there has at least `width` words."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        found = []
        for i, w in enumerate(words):
            q = nxt[state].get(w)
            while q is None and state:
                state = link[state]
                n = length[state]
                q = nxt[state].get(w)
            if q is None:
                n = 0
            else:
                state, n = q, n + 1
            if n >= width:
                found.append(i)
        return found


def _slide(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over every n consecutive values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words' runs of half the width, which of them are anchors, and each window's least hash (0 where no window starts)."""
    k = (width + 1) // 2
    w = width - k + 1
    g = runs(h, k)
    n = np.diff(first)
    if len(g) < w:
        return g, np.zeros(len(g), bool), np.zeros(0, np.uint64)
    room = np.repeat(first[1:], n) - np.arange(len(h))  # words from here to the text's end
    g = np.where(room[: len(g)] >= k, np.maximum(g, np.uint64(1)), MOST)
    least = _slide(g, w, np.minimum)
    least = np.where(room[: len(least)] >= width, least, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    return g, _slide(np.concatenate([pad, least, pad]), w, np.maximum) == g, least


def _sha(text: bytes) -> str:
    flat = text.translate(_FLAT)
    if b"  " in flat or flat[:1] == b" " or flat[-1:] == b" ":
        flat = b" ".join(flat.split())
    return hashlib.sha256(flat).hexdigest()


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def survey(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """For each row: doc_id, digest, n_words, the SHA-256 of all its words, and its anchors (keys and places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(2).to_pylist()):
                words = Words(texts)
                h = words.hashes()
                g, is_anchor, _ = anchors(h, words.first, width)
                spot = np.flatnonzero(is_anchor & (g != MOST))
                cut = np.searchsorted(spot, words.first)
                place = spot - np.repeat(words.first[:-1], np.diff(cut))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t)) for x, t in ((g[spot].view(np.int64), pa.int64()), (place, pa.int32()))]
                ids, keys = (batch.column(c).slice(at, len(texts)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(words.counts, pa.int64()), pa.array([_sha(t) for t in texts]), *lists], names=["doc_id", "digest", "n_words", "sha", "anchors", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), _digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, digest binary, n_words long, sha string, anchors array<long>, places array<int>")


def windows(texts: DataFrame, width: int) -> DataFrame:
    """For each text (rid, text, places of repeated anchors): the starts and hashes of the windows these anchors stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2).to_pylist()
            for at, some in blocks(batch.column(1).to_pylist()):
                words = Words(some)
                h = words.hashes()
                g, _, least = anchors(h, words.first, width)
                w = width - (width + 1) // 2 + 1
                marked = np.zeros(len(g), np.uint64)
                spots = np.concatenate([np.array(places[at + k], np.int64) + words.first[k] for k in range(len(some))])
                marked[spots] = g[spots]
                # A window is meant if one of its anchors, the runs with its least hash, is marked.
                meant = np.zeros(len(least), bool)
                for k in range(w):
                    meant |= marked[k : k + len(least)] == least
                start = np.flatnonzero(meant & (least > 0))
                full = runs(h, width, P1)
                cut = np.searchsorted(start, words.first)
                own = start - np.repeat(words.first[:-1], np.diff(cut))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, t)) for x, t in ((own, pa.int32()), (full[start].view(np.int64), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *lists], names=["rid", "starts", "hashes"])

    return texts.select("rid", "text", "places").mapInArrow(run, "rid long, starts array<int>, hashes array<long>")


def segments(texts: DataFrame, width: int, shards: int) -> DataFrame:
    """Passages for the shards: shard, rid, start, is_reference, and the words, joined by one space.

    texts has rid, text, base (the place of its first word) and hits: (start, place of the reference) of each repeated
    window. Consecutive windows whose references are in one block of places, or that are references themselves, make a segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64()]
        names = ["shard", "rid", "start", "is_reference", "words", "n"]
        for batch in batches:
            rids, texts_, bases, starts, refs = (batch.column(c).to_pylist() for c in range(5))
            rows: list[tuple] = []
            for rid, text, base, s, r in zip(rids, texts_, bases, starts, refs):
                words = text.encode("utf-8", "surrogatepass").split()
                s, r = np.array(s, np.int64), np.array(r, np.int64)
                order = np.argsort(s)
                s, r = s[order], r[order]
                block, own = r // _BLOCK, r == base + s
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 1) | (block[1:] != block[:-1]) | (own[1:] != own[:-1])]))
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(s)]):
                    lo, hi = int(s[a]), int(s[b - 1]) + width
                    shard = (int(block[a]) * P2 % (1 << 64) >> 20) % shards
                    rows.append((shard, rid, lo, bool(own[a]), b" ".join(words[lo:hi]), hi - lo))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return texts.select("rid", "text", "base", "hits.start", "hits.ref").mapInArrow(run, "shard int, rid long, start int, is_reference boolean, words binary, n long")


def confirm(parts: DataFrame, width: int) -> DataFrame:
    """rid and span (begin, end) of every maximal run of confirmed words in the segments, and of the references' passages."""
    volume = parts.where("NOT is_reference").groupBy("shard").agg((F.floor(F.sum("n") / PER_TASK) + 1).cast("int").alias("loads"))
    dealt = lookup(parts.where("NOT is_reference"), "shard", volume, F.struct("rid", "start"))
    stream = dealt.withColumn("part", F.pmod(F.xxhash64("rid", "start"), F.col("loads")).cast("int")).select("shard", "part", "rid", "start", "words")
    reference = parts.where("is_reference").join(volume, "shard").select(F.col("shard").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("part"), F.col("words").alias("words"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = Automaton()
        for words in right.column("words").to_pylist():
            automaton.add(words.split(b" "))
        rows: list[tuple] = []
        for rid, start, words in zip(*(left.column(c).to_pylist() for c in ("rid", "start", "words"))):
            ends = np.array(automaton.ends(words.split(b" "), width), np.int64)
            if len(ends):
                cut = np.flatnonzero(np.concatenate([[True], np.diff(ends) > width]))
                rows += [(rid, start + int(a) - width + 1, start + int(b) + 1) for a, b in zip(ends[cut], ends[np.append(cut[1:] - 1, len(ends) - 1)])]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.int32(), pa.int32()))], names=["rid", "begin", "end"])

    found = stream.groupBy("shard", "part").cogroup(reference.groupBy("shard", "part")).applyInArrow(run, "rid long, begin int, end int")
    return found.unionByName(parts.where("is_reference").select("rid", F.col("start").alias("begin"), (F.col("start") + F.col("n")).cast("int").alias("end")))


def cut_out(texts: DataFrame) -> DataFrame:
    """rid, n_removed, kept_sha256 and spans of texts (rid, text, spans) without the words in their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, text, begins, ends in zip(*(batch.column(c).to_pylist() for c in range(4))):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, begins, 1)
                np.add.at(gone, ends, -1)
                keep = np.cumsum(gone[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                rows.append((rid, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["rid", "n_removed", "kept_sha256", "kept"])

    return texts.select("rid", "text", "spans.begin", "spans.end").mapInArrow(run, "rid long, n_removed long, kept_sha256 string, kept string")


def _bases(texts: DataFrame) -> DataFrame:
    """rid, base: the place of each text's first word, with room for all its words up to the next one's.

    A place is a partition's number and 40 bits within it; rid, as monotonically_increasing_id gives it, has the partition in
    its upper bits. A text's words are no more than its characters.
    """
    part = F.shiftright("rid", 33)
    before = Window.partitionBy(part).orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    return texts.select("rid", (F.shiftleft(part, 40) + F.coalesce(F.sum(F.length("text") + F.lit(1)).over(before), F.lit(0))).alias("base"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row; with_text also kept, the text that is left (null: the input, unchanged)."""
    made = written(survey(docs, width, id_col, text_col), "survey")
    copies = made.groupBy("digest").agg(F.count("*").alias("copies"))
    # Keys with more than one place: places of equal texts count once, by the digest.
    rows = made.select("digest", F.explode(F.arrays_zip(F.col("anchors").alias("k"), F.col("places").alias("p"))).alias("a")).select("digest", F.col("a.k").alias("k"), F.col("a.p").alias("p"))
    spot = F.xxhash64("digest", "p")
    twice = rows.groupBy("k").agg(F.min(spot).alias("x"), F.max(spot).alias("y"), F.count("*").alias("n")).where("x <> y").select("k", "n")
    repeated = matched(rows, "k", written(twice, "keys")).groupBy("digest").agg(F.collect_set("p").alias("places"))
    repeated = written(repeated, "anchors")
    source = only_ids(docs.select(_digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), repeated.select("digest"), "digest")
    texts = source.join(repeated, "digest")
    if not copies.where("copies > 1").isEmpty():  # one of each group of equal texts: the first of each task, then the first of those
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"), F.first("places").alias("places"))
    texts = written(texts.select("digest", "text", "places", F.monotonically_increasing_id().alias("rid")), "texts")
    base = written(_bases(texts), "bases")
    held = windows(texts, width).join(base, "rid")
    spots = held.select("rid", "base", F.explode(F.arrays_zip(F.col("starts").alias("s"), F.col("hashes").alias("h"))).alias("a"))
    spots = written(spots.select("rid", F.col("a.h").alias("h"), F.col("a.s").alias("start"), (F.col("base") + F.col("a.s")).alias("at")), "windows")
    first = spots.groupBy("h").agg(F.min("at").alias("ref"), F.max("at").alias("last"), F.count("*").alias("n")).where("ref <> last").select("h", "ref", "n")
    hits = matched(spots, "h", written(first, "references")).groupBy("rid").agg(F.collect_list(F.struct("start", "ref")).alias("hits"))
    hits = written(hits, "hits")
    total = hits.select(F.sum(F.size("hits")).alias("n")).first()["n"] or 0
    parts = written(segments(texts.join(hits, "rid").join(base, "rid"), width, max(1, total // SHARD)), "segments")
    spans = confirm(parts, width).groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    cut = cut_out(texts.select("rid", "text").join(spans, "rid"))
    done = written(texts.select("rid", "digest").join(cut if with_text else cut.drop("kept"), "rid").drop("rid"), "cut")
    facts = copies.join(done, "digest", "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= width)
    empty = hashlib.sha256(b"").hexdigest()
    out = lookup(made.select("doc_id", "digest", "n_words", "sha"), "digest", facts, F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *[F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept")] * with_text,
    )
