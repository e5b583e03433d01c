"""Best-fit packing with large-item matching.

Token counts are cut into pieces of at most `capacity`. Pieces above a third of the capacity can stand at most two to a
sequence, so they are matched greedily, largest first, each with the largest other one that still fits. Smaller pieces
follow by decreasing length, each into the smallest gap that holds it.

Only the histogram of lengths (at most `capacity` rows) reaches the driver. There the packing is worked out on counts: a
pattern of lengths and how many sequences have it. Pieces then find their place by their rank among equally long ones, so
no task ever holds more than its own share of the pieces.

Defined results: null text is the empty text (one piece with the end id alone); a null id is kept; equal rows are packed
separately; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumeno.llm.common import written
from lumeno.llm.wordhash import P1, P2, Words, blocks

DIGITS = frozenset("0123456789")

#: Different words, and different parts of words, whose ids a Python worker remembers.
CACHE = 600_000


class WordIds:
    """Ids of whitespace-separated words, remembered by a 128-bit hash. For lower-casing byte-level BPE with word ends.

    Such a tokenizer never merges across white space, and the last id of each part of a word is that of a token with a
    word end; so many parts can be encoded as one text and told apart again.
    """

    _latin = re.compile("[\x21-\x26\x28-\x3b\x3d-\x7e\u00a1-\u024f]+")
    _parts = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.word_end[k] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, list[int]] = {}
        self.n, self.used, self.bits = 0, 0, 21
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros((CACHE, 2), np.uint64)
        self.first, self.length = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1: linear probing, all words in step."""
        at = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slot[at]
        ask = np.flatnonzero((found >= 0) & ((self.key[found, 0] != a) | (self.key[found, 1] != b)))
        while len(ask):
            at[ask] = (at[ask] + 1) & ((1 << self.bits) - 1)
            e = found[ask] = self.slot[at[ask]]
            ask = ask[(e >= 0) & ((self.key[e, 0] != a[ask]) | (self.key[e, 1] != b[ask]))]
        return found

    def split(self, word: str) -> list[str] | None:
        """Its parts, if simple rules give them; else the tokenizer has to see the whole word."""
        if not self._latin.fullmatch(word) or not unicodedata.is_normalized("NFC", word):
            return None
        low = "".join(map(str.lower, word)) if not word.isascii() else word.lower()
        parts = self._parts.findall(low)
        return parts if all(p.isalpha() or p in DIGITS or not any(c.isalnum() or unicodedata.category(c)[0] in "NL" for c in p) for p in parts) else None

    def part_ids(self, new: list[str]) -> None:
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            ids = self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(some):
                self.parts.update(zip(some, [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]))
            else:
                self.parts.update((p, self.tokenizer.encode(p, add_special_tokens=False).ids) for p in some)

    def learn(self, new: list[bytes], a: np.ndarray, b: np.ndarray) -> None:
        text = [w.decode("utf-8", "replace") for w in new]
        split = [self.split(w) for w in text]
        self.part_ids(list({p for ps in split if ps for p in ps} - self.parts.keys()))
        parts = self.parts
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids if ps is None else parts[ps[0]] if len(ps) == 1 else [i for p in ps for i in parts[p]] for w, ps in zip(text, split)]
        sizes, n = np.fromiter(map(len, found), np.int64, len(found)), len(new)
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        while self.n + n > len(self.key):
            self.key, self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.key, self.first, self.length))
        k = slice(self.n, self.n + n)
        self.key[k, 0], self.key[k, 1] = a, b
        self.length[k] = sizes
        self.first[k] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = self.n + n, self.used + total
        if self.n * 2 > len(self.slot):
            self.bits += 1
            self.slot = np.full(1 << self.bits, -1, np.int32)
            self._seat(np.arange(self.n))
        else:
            self._seat(np.arange(self.n - n, self.n))

    def _seat(self, entries: np.ndarray) -> None:
        at = (self.key[entries, 0] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entries):
            free = self.slot[at] < 0
            self.slot[at[free]] = entries[free]
            left = self.slot[at] != entries
            entries, at = entries[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if self.n > CACHE or len(self.parts) > CACHE:
            self.clear()
        words = Words(texts)
        a, b = words.hashes(P1), words.hashes(P2)
        entry = self.find(a, b)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            _, k = np.unique(a[miss], return_index=True)
            k = miss[k]
            self.learn([words.word(i) for i in k.tolist()], a[k], b[k])
            entry[miss] = self.find(a[miss], b[miss])
        size = self.length[entry]
        ends = np.cumsum(size)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[entry] - (ends - size), size)
        cuts = np.concatenate([[0], ends])[words.first]
        return self.ids[where], np.diff(cuts)


_ready: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's table for a vocabulary; it outlives a task."""
    if path not in _ready:
        _ready[path] = WordIds(path)
    return _ready[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, and its partition and its rank among that partition's equally long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, pid = word_ids(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        for batch in batches:
            keys, schema = batch.column(0).to_pylist(), pa.schema([("doc_id", batch.column(0).type), *rest])
            for first, texts in blocks(batch.column(1).to_pylist()):
                flat, sizes = words.encode(texts)
                rows, at = [], 0
                for key, n in zip(keys[first:], sizes.tolist()):
                    own = np.concatenate([flat[at : at + n], end]).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = own[start : start + capacity]
                        rows.append((key, k, start, len(part), zlib.crc32(part), pid, int(seen[len(part)])))
                        seen[len(part)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rest = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int32()), ("local_rank", pa.int64())]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, pid int, local_rank long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns and the number of sequences of each; a pattern lists (length, copies)."""
    left, bins, gaps = dict(counts), {}, []

    def add(gap: int, pattern: tuple, n: int) -> None:
        if n:
            if gap not in bins:
                bins[gap] = []
                bisect.insort(gaps, gap)
            bins[gap].append((pattern, n))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        top = large[-1]
        k = bisect.bisect_right(large, capacity - top) - 1
        if k >= 0 and large[k] == top and left[top] == 1:
            k -= 1
        if k < 0:
            add(capacity - top, ((top, 1),), left[top])
            left[top] = 0
        else:
            mate = large[k]
            n = left[top] // 2 if mate == top else min(left[top], left[mate])
            left[top] -= n
            left[mate] -= n
            add(capacity - top - mate, ((top, 2),) if mate == top else ((top, 1), (mate, 1)), n)
            if not left[mate] and mate != top:
                large.pop(k)
        if not left[top]:
            large.pop()
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        n = left[x]
        while n:
            k = bisect.bisect_left(gaps, x)
            if k == len(gaps):
                add(capacity, (), -(-n // (capacity // x)))
                continue
            gap = gaps[k]
            pattern, m = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[k]
            copies = min(gap // x, n)
            used = min(m, n // copies)
            n -= used * copies
            add(gap, pattern, m - used)
            add(gap - copies * x, (*pattern, (x, copies)), used)
    return [b for gap in gaps for b in bins[gap]]


def slots(patterns: list, capacity: int) -> dict[str, np.ndarray]:
    """For each length its slots by rank: first rank, copies in one sequence, first sequence, offset."""
    rank, rows, sequence = {}, [], 0
    for pattern, n in patterns:
        offset = 0
        for x, copies in pattern:
            rows.append((x, rank.get(x, 0), copies, sequence, offset))
            rank[x] = rank.get(x, 0) + n * copies
            offset += x * copies
        sequence += n
    made = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: made[:, i] for i, k in enumerate(("length", "rank", "copies", "sequence", "offset"))}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece; see the module's text."""
    spark = docs.sparkSession
    made = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    local = made.groupBy("pid", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    place = spark.sparkContext.broadcast(slots(plan(counts, capacity), capacity))  # its size follows from the capacity
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = local.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(base, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, step = place.value, 1 << 42
        keys = p["length"] * step + p["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            k = np.searchsorted(keys, length * step + rank, "right") - 1
            since = rank - p["rank"][k]
            sequence, offset = p["sequence"][k] + since // p["copies"][k], p["offset"][k] + since % p["copies"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {ranked.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
