"""Alignment of two tokenizers by segment deduplication.

A text with a space before it is cut before its runs of white space, and each distinct segment of the corpus is tokenised
once. That gives the tokens of the whole text, since no token reaches over a cut: `cut_spaces` takes a white-space character
only if no entry of either vocabulary has it behind anything but white space, so that no merge can make such a token,
and the byte-level pattern never matches over the start of a run either. A run is cut only behind what Python and
the pattern both call no white space. The piece model puts a space before what it is given: a segment that starts with a space
is given without it, and of others that first piece, which no entry merges with a line end or tab, is dropped.
Cuts are ends of tokens of both kinds, so groups don't reach over them, and a text's alignment is that of its segments in turn.

A task cuts a block of texts, keeps each segment once, and the texts as numbers of segments. The blocks' segments are dealt to
buckets by hash, as many as the corpus asks for; there each distinct one is tokenised and its bytes checked, and what
it gives goes back to all blocks that hold it. Blocks joined with that count in how many of their texts each pair of ids
is linked. When the counts are summed, blocks are joined with their pairs' counts as well, and texts composed.
A frequent segment is one row a block in its bucket; a frequent pair one row a block, summed before the shuffle.

Defined results: null and empty texts, and texts whose tokens' bytes are not the text's (as with U+2581, which a piece can't
tell from a space), have no tokens, zeros and an empty digest; their other segments count for nothing; texts without white space
are one segment; null ids are kept; repeated rows are texts of their own, and count each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lumeno.llm.common import zipped

#: Characters of a block of texts, segments of a bucket (more or less), and segments tokenised at a time.
BLOCK, BUCKET, BATCH = 10_000_000, 200_000, 4096
MARK, CANDIDATES = "▁", " \n\t\r\x0b\x0c"


@functools.cache
def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 ones for themselves, the others in turn for those from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def cut_spaces(entries_a: list[bytes], entries_b: list[bytes]) -> str:
    """The white-space characters before which texts may be cut: no entry has one behind anything but white space, and, spaces
    apart, none of B has one behind a space that may be the one the model puts before a text."""
    a, b = ([x.decode("utf-8", "replace") for x in entries] for entries in (entries_a, entries_b))  # what is no whole character is no white space
    found = []
    for c in CANDIDATES:
        over, led = re.compile("\\S" + re.escape(c)), re.compile("^ +" + re.escape(c))
        if not any(over.search(x) for x in (*a, *b)) and (c == " " or not any(led.search(x) for x in b)):
            found.append(c)
    return "".join(found)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Cutter:
    """Cuts texts before runs of white space that start with one of `spaces`."""

    def __init__(self, spaces: str):
        self.other = re.compile(f"[^\\S{re.escape(spaces)}]")
        self.plain = re.compile("\\s*\\S+|\\s+")
        self.exact = re.compile(f"(?<=\\S)(?=[{re.escape(spaces)}])")

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = " " + text
        return self.exact.split(text) if self.other.search(text) else self.plain.findall(text)


class Pair:
    """Both tokenizers, with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are text
        to_byte = byte_level()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        own = [x for i, x in enumerate(self.b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.space = self.b.piece_to_id(MARK)
        if b"".join(self.b_bytes[i] for i in self.b.encode(" a  b ")) != b"  a  b ":
            raise ValueError("the piece model has to keep spaces and put one before a text")
        self.spaces = cut_spaces(self.a_bytes, own)
        self.cutter = Cutter(self.spaces)

    def tokens(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of each segment, none where their bytes aren't the segment's."""
        spaced = [s[0] == " " for s in segments]
        a = [x.ids for x in self.a.encode_batch(segments, add_special_tokens=False)]
        b = [x if own else x[1:] for x, own in zip(self.b.encode([s[1:] if own else s for s, own in zip(segments, spaced)], num_threads=1), spaced)]
        made = []
        for s, x, y in zip(segments, a, b):
            y, raw = [self.space] if s == " " else y, s.encode("utf-8", "surrogatepass")
            ok = b"".join([self.a_bytes[i] for i in x]) == raw and b"".join([self.b_bytes[i] for i in y]) == raw
            made.append((x, y) if ok else ([], []))
        return made


@functools.cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2^24 by planes of bytes, so that the small ones' empty bytes cost little."""
    v = values.astype(np.uint32)
    return len(v).to_bytes(8, "little") + pa.compress(b"".join((v >> np.uint32(k) & np.uint32(255)).astype(np.uint8).tobytes() for k in (0, 8, 16, 24)), codec="zstd", asbytes=True)


def unsqueezed(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def cut(docs: DataFrame, spaces: str, kind: str) -> DataFrame:
    """block, n_segments, ids, first, seq, segments: the texts of a block as numbers of its segments, text k from first[k] to first[k + 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, task, n = Cutter(spaces), TaskContext.get().partitionId(), 0
        numbers, ids, first, seq, held = Numbers(), [], [0], [], 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(seq) if seq else np.zeros(0, np.int32)
            cols = [pa.array([task << 32 | n]), pa.array([len(numbers)]), pa.ListArray.from_arrays(pa.array([0, len(first) - 1], pa.int32()), pa.concat_arrays(ids)), pa.array([first], pa.list_(pa.int64())), pa.array([squeezed(flat)], pa.binary()), pa.array([list(numbers)], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["block", "n_segments", "ids", "first", "seq", "segments"])

        for batch in batches:
            start = 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = np.array(list(map(numbers.__getitem__, cutter.segments(text))), np.int32)
                seq.append(own)
                first.append(first[-1] + len(own))
                held += len(text or "") + 20
                if held >= BLOCK or k == batch.num_rows - 1:
                    ids.append(batch.column(0).slice(start, k + 1 - start))
                    start = k + 1
                if held >= BLOCK:
                    yield row()
                    n += 1
                    numbers, ids, first, seq, held = Numbers(), [], [0], [], 0
        if len(first) > 1:
            yield row()

    return docs.mapInArrow(run, f"block long, n_segments long, ids array<{kind}>, first array<long>, seq binary, segments array<string>")


TOKENS = "block long, ks array<int>, n_a array<int>, n_b array<int>, a binary, b binary"


def tokenised(blocks: DataFrame, paths: tuple[str, str], buckets: int) -> DataFrame:
    """For each block and bucket the numbers of the block's segments there, and their tokens; each distinct segment is tokenised once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, segments in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts = segments.values
                at = np.array([zlib.crc32(s) % buckets for s in texts.cast(pa.binary()).to_pylist()], np.int64)
                order = np.argsort(at, kind="stable")
                new = np.flatnonzero(np.diff(at[order], prepend=-1))
                ends = pa.array(np.append(new, len(order)), pa.int32())
                cols = [pa.array(at[order][new]), pa.array(np.full(len(new), block, np.int64)), pa.ListArray.from_arrays(ends, pa.array(order, pa.int32())), pa.ListArray.from_arrays(ends, texts.take(pa.array(order)))]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "ks", "segments"])

    def tokens(t: pa.Table) -> pa.Table:
        both, numbers = pair(*paths), Numbers()
        wide_a, wide_b = ("<u2" if len(x) <= 1 << 16 else "<u4" for x in (both.a_bytes, both.b_bytes))
        held = [np.array(list(map(numbers.__getitem__, s)), np.int64) for s in t.column("segments").to_pylist()]
        distinct, made = list(numbers), []
        for k in range(0, len(distinct), BATCH):
            made += [(len(a), len(b), np.array(a, wide_a).tobytes(), np.array(b, wide_b).tobytes()) for a, b in both.tokens(distinct[k : k + BATCH])]
        cols: list[list] = [[], [], [], []]
        for own in held:
            rows = [made[k] for k in own.tolist()]
            for c, values in zip(cols, zip(*rows)):
                c.append(list(values) if isinstance(values[0], int) else b"".join(values))
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.table([t.column("block"), t.column("ks"), *(pa.array(c, kind) for c, kind in zip(cols, kinds))], names=["block", "ks", "n_a", "n_b", "a", "b"])

    dealt = blocks.select("block", "segments").mapInArrow(deal, "bucket long, block long, ks array<int>, segments array<string>")
    return zipped(dealt.groupBy("bucket").applyInArrow(tokens, TOKENS), "tokens")


class Aligned:
    """The alignments of a block's segments, end to end on one axis of bytes: every stretch between two ends is a link, every end that is one of both kinds closes a group."""

    def __init__(self, n: int, tokens: pa.Table, sizes: tuple[np.ndarray, np.ndarray]):
        self.n_a, self.n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat = lambda c: np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in tokens.column(c).chunks)])
        order = flat("ks")
        self.n_a[order], self.n_b[order] = flat("n_a"), flat("n_b")
        wide = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in sizes]
        raw = [np.frombuffer(b"".join(tokens.column(c).to_pylist()), w) for c, w in zip("ab", wide)]
        self.a, self.b = (_in_order(r, k[order], order) for r, k in zip(raw, (self.n_a, self.n_b)))
        self.end_a, self.end_b = (np.cumsum(t[i]) for t, i in zip(sizes, (self.a, self.b)))
        ends = np.unique(np.concatenate([self.end_a, self.end_b]))
        of_a, of_b = np.searchsorted(self.end_a, ends), np.searchsorted(self.end_b, ends)
        self.link = self.a[of_a] << 32 | self.b[of_b]
        segment = np.repeat(np.arange(n), self.n_a)[of_a]
        self.n_links = np.bincount(segment, minlength=n)
        closes = (self.end_a[of_a] == ends) & (self.end_b[of_b] == ends)
        self.closed = ends[closes]
        self.n_groups = np.bincount(segment[closes], minlength=n)
        self.first_link = np.concatenate([[0], np.cumsum(self.n_links)])

    def texts(self, some: int = 50_000) -> list[str]:
        """The groups of each segment as text, made for so many segments at a time."""
        group = [np.searchsorted(self.closed, e) for e in (self.end_a, self.end_b)]
        ends_segment = np.zeros(len(self.closed), bool)
        ends_segment[np.cumsum(self.n_groups)[self.n_groups > 0] - 1] = True
        at = [np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b)]
        out: list[str] = []
        for lo in range(0, len(self.n_a), some):
            hi = min(lo + some, len(self.n_a))
            a, b = (slice(x[lo], x[hi]) for x in at)
            key = np.concatenate([2 * group[0][a], 2 * group[1][b] + 1])
            order = np.argsort(key, kind="stable")
            ids, key = np.concatenate([self.a[a], self.b[b]])[order], key[order]
            last = np.append(key[1:] != key[:-1], True)[: len(key)]  # of its kind in its group
            after = np.where(~last, 0, np.where(key % 2 == 0, 1, np.where(ends_segment[key // 2], 3, 2)))
            made = iter("".join([str(i) + ",|;\n"[k] for i, k in zip(ids.tolist(), after.tolist())]).split("\n"))
            out += [next(made) if n else "" for n in self.n_groups[lo:hi].tolist()]
        return out


def _in_order(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of flat, whose k-th belongs to number order[k], in order of the numbers."""
    start = np.cumsum(sizes) - sizes
    by = np.argsort(order, kind="stable")
    n = sizes[by]
    begin = np.cumsum(n) - n
    return flat[np.repeat(start[by] - begin, n) + np.arange(n.sum())].astype(np.int64)


def _whole(seq: np.ndarray, first: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Which texts have no segment that isn't ok, and any."""
    bad = np.concatenate([[0], np.cumsum(~ok[seq])])
    return (bad[first[1:]] == bad[first[:-1]]) & (first[1:] > first[:-1])


def _linked_texts(seq: np.ndarray, first: np.ndarray, whole: np.ndarray, made: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids linked in any text, and in how many."""
    pairs, of_link = np.unique(made.link, return_inverse=True)
    counts, at = np.zeros(len(pairs), np.int64), np.flatnonzero(whole)
    sizes = np.diff(first)[at]
    for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes) // 65_536)) + 1) if len(at) else []:
        n = first[some + 1] - first[some]
        own = seq[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        key = np.unique(np.repeat(np.arange(len(some)), n) * len(made.n_a) + own)
        text, segment = key // len(made.n_a), key % len(made.n_a)
        n = made.n_links[segment]
        links = of_link[np.repeat(made.first_link[segment] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        counts += np.bincount(np.unique(np.repeat(text, n) * len(pairs) + links) % len(pairs), minlength=len(pairs))
    return pairs[counts > 0], counts[counts > 0]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    paths, kind = (a_path, b_path), docs.schema[id_col].dataType.simpleString()
    both = pair(*paths)
    sizes = tuple(np.array([len(x) for x in t], np.int64) for t in (both.a_bytes, both.b_bytes))  # a number for each id
    blocks = zipped(cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), both.spaces, kind), "blocks")
    total = blocks.agg(F.sum("n_segments")).first()[0] or 0
    tokens = tokenised(blocks, paths, total // BUCKET + 1)

    def opened(t: pa.Table, known: pa.Table) -> tuple:
        row = {c: t.column(c)[0] for c in t.column_names}
        seq, first = unsqueezed(row["seq"].as_py()), np.array(row["first"].as_py(), np.int64)
        made = Aligned(row["n_segments"].as_py(), known, sizes)
        return row, seq, first, _whole(seq, first, made.n_a > 0), made

    def count(t: pa.Table, known: pa.Table) -> pa.Table:
        row, seq, first, whole, made = opened(t, known)
        pairs, n = _linked_texts(seq, first, whole, made)
        return pa.table([pa.array(np.full(len(n), row["block"].as_py(), np.int64)), pa.array(pairs), pa.array(n)], names=["block", "pair", "n"])

    def compose(t: pa.Table, known: pa.Table) -> pa.Table:
        row, seq, first, whole, made = opened(t, known)
        pairs, n = (np.array(row[c].as_py() or [], np.int64) for c in ("pairs", "n"))
        best = np.array(row["best"].as_py() or [], bool)
        order = np.argsort(pairs)
        # Links of segments that only texts without tokens have are not counted, and not asked for.
        at = order[np.minimum(np.searchsorted(pairs[order], made.link), len(pairs) - 1)] if len(pairs) else np.zeros(len(made.link), np.int64)
        summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[at])])[made.first_link]) if len(pairs) else np.zeros(len(made.n_a), np.int64)
        cols = []
        for v in (made.n_a, made.n_b, made.n_groups, made.n_links, summed(best.astype(np.int64)), summed(n)):
            sums = np.concatenate([[0], np.cumsum(v[seq])])[first]
            cols.append(pa.array(np.where(whole, np.diff(sums), 0)))
        texts = made.texts()
        sha = [hashlib.sha256(";".join(map(texts.__getitem__, seq[lo:hi].tolist())).encode()).hexdigest() if ok else "" for lo, hi, ok in zip(first[:-1].tolist(), first[1:].tolist(), whole.tolist())]
        return pa.table([row["ids"].values, *cols, pa.array(sha, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    slim = blocks.drop("segments")
    found = zipped(slim.drop("ids").groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(count, "block long, pair long, n long"), "pairs")
    counts = found.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))
    weights = found.select("block", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("w"))
    full = slim.join(weights.select("block", F.col("w.pair").alias("pairs"), F.col("w.n").alias("n"), F.col("w.best").alias("best")), "block", "left")
    return full.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(compose, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
