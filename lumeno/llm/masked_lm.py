"""Language-model scores by masked pseudo-likelihood.

A network sees the two words on either side of a position and predicts the word there: embeddings, one tanh layer with a
matrix for each of the four places, and a softmax in two steps (class, then member), so that a prediction costs two small
products. A text's score is the sum of the conditional log-probabilities of all its words, each given both sides.

The network's vocabulary is the `KNOWN` most frequent words of the whole corpus and `TAILS` members that stand for all other
words, by their last two bytes. Another word's probability is that of its tail member, given both sides, times the word's
share of the tail in the counts of the whole corpus, with `SMOOTH` added to each count, also to that of an unseen word. So every
word has a probability of its own. The counts are a distributed table that grows with the corpus; texts' tail words are joined with it.

The network is trained on every text: in each of `ROUNDS` rounds all tasks start at the same weights, mask every `EVERY`-th word
of their texts, other words in each round, and learn to predict it from both sides; then the tasks' weights are averaged,
weighed by their words. So half of all words are targets once, and all are contexts and are counted. What reaches the driver
(vocabulary, tail totals, averaged weights) is of fixed size, and no task holds more than one model.

Defined results: null and empty texts have no words, pll 0 and mean_log_prob 0; a word at a text's edge sees a blank there;
repeated rows are scored each and alike; an empty table gives an empty result; other columns are ignored. The weights depend on
which texts a task reads, so other partitions of the same table give slightly other scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeno.llm.common import written
from lumeno.llm.wordhash import Words, blocks, mix

CLASSES, MEMBERS = 16, 128
SIZE = CLASSES * MEMBERS
TAILS = 64
KNOWN = SIZE - TAILS
DIM, HIDDEN, ROUNDS, EVERY, BATCH, SMOOTH = 24, 32, 2, 4, 2048, 0.1
PLACES = (-2, -1, 1, 2)
SHAPES = {"emb": (SIZE + 1, DIM), "mixer": (len(PLACES) * DIM, HIDDEN), "bias": (HIDDEN,), "cls": (HIDDEN, CLASSES), "cls_bias": (CLASSES,), "member": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}


def tails(words: Words) -> np.ndarray:
    """Each word's tail member, by its last two bytes."""
    b, end = words.bytes, words.end
    last = b[end - 1].astype(np.uint64)
    before = np.where(end - words.start > 1, b[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    return (mix(last * np.uint64(257) + before) % np.uint64(TAILS)).astype(np.int64)


class Vocabulary:
    def __init__(self, hashes: list[int]):
        known = np.array([h & 0xFFFFFFFFFFFFFFFF for h in hashes], np.uint64)
        self.order = np.argsort(known)
        self.known = known[self.order]

    def ids(self, words: Words, h: np.ndarray | None = None) -> np.ndarray:
        h, tail = words.hashes() if h is None else h, KNOWN + tails(words)
        if not len(self.known):
            return tail
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.order[at], tail)


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ids at the four places around each word; SIZE is the blank."""
    n, text = len(ids), np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((n, len(PLACES)), SIZE, np.int64)
    for k, o in enumerate(PLACES):
        at = np.arange(max(0, -o), n - max(0, o))
        at = at[text[at] == text[at + o]]
        out[at, k] = ids[at + o]
    return out


def start(counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights, and biases that give the words' frequencies."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(0, 0.1 if k == "emb" else shape[0] ** -0.5, shape) if k in ("emb", "mixer") else np.zeros(shape)).astype(np.float32) for k, shape in SHAPES.items()}
    w["emb"][SIZE] = 0
    c = (counts + 0.5).reshape(CLASSES, MEMBERS)
    w["member_bias"] = np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32)
    w["cls_bias"] = np.log(c.sum(axis=1) / c.sum()).astype(np.float32)
    return w


def _soft(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class Learner:
    """Adagrad on masked words, from given weights."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float = 0.15):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.g = {k: np.full_like(v, 1e-2) for k, v in weights.items()}
        self.rate = rate

    def _step(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        self.g[name][at] += grad * grad
        self.w[name][at] -= self.rate * grad / np.sqrt(self.g[name][at])

    def learn(self, ctx: np.ndarray, target: np.ndarray) -> None:
        w, n = self.w, len(target)
        order = np.argsort((target // MEMBERS).astype(np.uint8), kind="stable")  # words of one class beside each other; a radix sort
        ctx, target = ctx[order], target[order]
        cls, member = target // MEMBERS, target % MEMBERS
        x = w["emb"][ctx].reshape(n, -1)
        h = np.tanh(x @ w["mixer"] + w["bias"])
        d = _soft(h @ w["cls"] + w["cls_bias"])
        d[np.arange(n), cls] -= 1
        d /= n
        back = d @ w["cls"].T
        grads = {"cls": h.T @ d, "cls_bias": d.sum(axis=0)}
        cut = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        for c, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if lo == hi:
                continue
            own = h[lo:hi]
            e = _soft(own @ w["member"][c] + w["member_bias"][c])
            e[np.arange(hi - lo), member[lo:hi]] -= 1
            e /= n
            back[lo:hi] += e @ w["member"][c].T
            self._step("member", own.T @ e, c)
            self._step("member_bias", e.sum(axis=0), c)
        back *= 1 - h * h
        grads |= {"mixer": x.T @ back, "bias": back.sum(axis=0)}
        dx = (back @ w["mixer"].T).reshape(-1, DIM)
        flat = ctx.ravel()
        by = np.argsort(flat.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(flat[by], prepend=-1))
        at, ge = flat[by[first]], np.add.reduceat(dx[by], first, axis=0)
        ge[at == SIZE] = 0
        for name, grad in grads.items():
            self._step(name, grad)
        self._step("emb", ge, at)


def log_probs(ids: np.ndarray, ctx: np.ndarray, w: dict[str, np.ndarray], chunk: int = 16384) -> np.ndarray:
    """The conditional log-probability of each word."""
    tables = [w["emb"] @ w["mixer"][k * DIM : (k + 1) * DIM] for k in range(len(PLACES))]
    out = np.empty(len(ids), np.float64)
    for lo in range(0, len(ids), chunk):
        own, around = ids[lo : lo + chunk], ctx[lo : lo + chunk]
        h = tables[0][around[:, 0]] + w["bias"]
        for k in range(1, len(PLACES)):
            h += tables[k][around[:, k]]
        np.tanh(h, out=h)
        cls, member = own // MEMBERS, own % MEMBERS
        x = h @ w["cls"] + w["cls_bias"]
        top = x.max(axis=1)
        lp = x[np.arange(len(own)), cls] - top - np.log(np.exp(x - top[:, None]).sum(axis=1))
        order = np.argsort(cls, kind="stable")
        cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[cut[c] : cut[c + 1]]
            if len(rows):
                y = h[rows] @ w["member"][c] + w["member_bias"][c]
                top = y.max(axis=1)
                lp[rows] += y[np.arange(len(rows)), member[rows]] - top - np.log(np.exp(y - top[:, None]).sum(axis=1))
        out[lo : lo + chunk] = lp
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """h, tail, n: how often each word, by its hash, occurs in the column text; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, at, inverse = np.unique(np.concatenate([k for k, _, _ in held]), return_index=True, return_inverse=True)
            return keys, np.concatenate([t for _, t, _ in held])[at], np.bincount(inverse, np.concatenate([n for _, _, n in held])).astype(np.int64)

        def rows(keys: np.ndarray, tail: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(tail, pa.int32()), pa.array(n)], names=["h", "tail", "n"])

        for batch in batches:
            for _, some in blocks(batch.column(0).to_pylist()):
                words = Words(some)
                keys, at, n = np.unique(words.hashes(), return_index=True, return_counts=True)
                held.append((keys, tails(words)[at], n))
                if len(held) >= 8:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:  # what grows beyond that is summed by the shuffle
                        yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return texts.select("text").mapInArrow(run, "h long, tail int, n long").groupBy("h", "tail").agg(F.sum("n").alias("n"))


class Model:
    """Vocabulary, weights, and of each tail the logarithm of its words' number."""

    def __init__(self, vocabulary: Vocabulary, weights: dict[str, np.ndarray], totals: np.ndarray):
        self.vocabulary, self.weights, self.totals = vocabulary, weights, totals


def fit(texts: DataFrame, counted: DataFrame, rounds: int = ROUNDS) -> Model:
    """A model from all rows of the column text and their words' counts."""
    top = counted.orderBy(F.desc("n"), "h").limit(KNOWN).collect()
    vocabulary = Vocabulary([r["h"] for r in top])
    counts, kinds = np.zeros(SIZE), np.zeros(TAILS)
    counts[: len(top)] = [r["n"] for r in top]
    for r in counted.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # TAILS rows at most
        counts[KNOWN + r["tail"]], kinds[r["tail"]] = r["n"], r["k"]
    for r in top:
        counts[KNOWN + r["tail"]] -= r["n"]
        kinds[r["tail"]] -= 1
    weights = start(counts)
    for k in range(rounds):
        weights = one_round(texts, vocabulary, weights, k, rounds)
    return Model(vocabulary, weights, np.log(counts[KNOWN:] + SMOOTH * (kinds + 1)))


def one_round(texts: DataFrame, vocabulary: Vocabulary, weights: dict[str, np.ndarray], k: int, rounds: int) -> dict[str, np.ndarray]:
    """The tasks' weights after learning the k-th round's words, averaged."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        learner, seen = Learner(w), 0
        for batch in batches:
            for _, some in blocks(batch.column(0).to_pylist()):
                words = Words(some)
                ids = known.ids(words)
                ctx = contexts(ids, words.first)
                masked = np.random.default_rng(seen).permutation(np.arange((k * EVERY // rounds - seen) % EVERY, len(ids), EVERY))
                seen += len(ids)
                for at in np.array_split(masked, max(1, round(len(masked) / min(BATCH, max(256, len(masked) // 32))))):
                    if len(at):
                        learner.learn(ctx[at], ids[at])
        if seen:
            for name, v in learner.w.items():
                flat = v.ravel()
                for lo in range(0, len(flat), 4096):
                    yield pa.RecordBatch.from_pydict({"name": [name], "lo": [lo], "words": [float(seen)], "values": [flat[lo : lo + 4096]]}, schema=schema)

    schema = pa.schema([("name", pa.string()), ("lo", pa.int64()), ("words", pa.float64()), ("values", pa.list_(pa.float32()))])
    parts = texts.select("text").mapInArrow(run, "name string, lo long, words double, values array<float>")
    flat = parts.select("name", "lo", "words", F.posexplode("values").alias("i", "v"))
    mean = flat.groupBy("name", (F.col("lo") + F.col("i")).alias("at")).agg((F.sum(F.col("v") * F.col("words")) / F.sum("words")).cast("float").alias("v"))
    made = dict(weights)
    for name, rows in mean.groupBy("name").agg(F.collect_list(F.struct("at", "v")).alias("x")).toLocalIterator():  # as many values as the model has
        values = np.array(sorted((r["at"], r["v"]) for r in rows))
        made[name] = values[:, 1].astype(np.float32).reshape(SHAPES[name])
    shared.unpersist()
    return made


def score(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, pll, mean_log_prob, perplexity for each row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = written(word_counts(texts), "counts")
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, counted, rounds))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for at, some in blocks(batch.column(1).to_pylist()):
                words = Words(some)
                h = words.hashes()
                ids = m.vocabulary.ids(words, h)
                lp, text = log_probs(ids, contexts(ids, words.first), m.weights), np.repeat(np.arange(len(some)), words.counts)
                rare = ids >= KNOWN
                lp[rare] -= m.totals[ids[rare] - KNOWN]
                pll = np.bincount(text, lp, len(some)).astype(np.float64)  # without any word bincount gives integers
                order = np.lexsort((h[rare], text[rare]))
                key, own = h[rare][order], text[rare][order]
                new = np.flatnonzero((np.diff(key, prepend=0) != 0) | (np.diff(own, prepend=-1) != 0)) if len(key) else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(some)))])
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (key[new].view(np.int64), np.diff(np.append(new, len(key))).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(words.counts.astype(np.int64)), pa.array(pll), *lists], names=["doc_id", "n_tokens", "pll", "rare", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, pll double, rare array<long>, times array<int>")
    made = written(made.withColumn("_rid", F.monotonically_increasing_id()), "scores")
    rare = made.select("_rid", F.explode(F.arrays_zip(F.col("rare").alias("h"), F.col("times").alias("m"))).alias("x")).select("_rid", F.col("x.h").alias("h"), F.col("x.m").alias("m"))
    logs = rare.join(counted.select("h", F.log(F.col("n") + SMOOTH).alias("log_n")), "h", "left")
    share = logs.groupBy("_rid").agg(F.sum(F.col("m") * F.coalesce("log_n", F.lit(math.log(SMOOTH)))).alias("more"))
    full = made.drop("rare", "times").join(share, "_rid", "left").withColumn("pll", F.col("pll") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).otherwise(0.0)
    return full.select("doc_id", "n_tokens", "pll", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
