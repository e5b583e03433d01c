"""Quality: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are binned statistics of the line and of its two neighbours; the chain adds the
weights of the four transitions. A document's score is the mean of its lines' marginal probabilities of being good,
weighed by their length. Forward and backward sums run as parallel prefix products of 2 x 2 matrices over all lines of a
block; at a document's first line both rows of the matrix are equal, which cuts the chain there.

Labels are of texts, so those of lines are latent. Training first takes each text's label for all its lines and uses their own statistics only, as
neighbours and transitions would only copy the label along. Then, twice, lines that the model holds to be of the other kind with
70 % are given that label, unless that leaves less than half of the text to its own label, and the model is trained on with
neighbours and transitions. It is bounded: at most `SAMPLE` rows of each class reach the driver, the ones with the smallest
hash of their id. Every text is scored whole.

Defined results: null and empty texts have one empty line and its score; repeated rows are scored each; without labels of
both classes every score is 1 or 0, by the class there is (1 without labels); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeno.llm.common import held_out
from lumeno.llm.toxicity import sample
from lumeno.llm.wordhash import P1, blocks, mix, powers

SAMPLE = 2500
#: Upper ends of the bins of each statistic of a line.
BINS = {
    "words": (0, 2, 5, 10, 20, 40, 80),
    "word_length": (2, 3, 4, 5, 6, 7, 9, 12),
    "upper": (0.01, 0.03, 0.1, 0.3, 0.6),
    "symbols": (0.0, 0.01, 0.03, 0.06, 0.12, 0.25),
    "stops": (0.0, 0.01, 0.02, 0.04, 0.08),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "seen": (0.0, 0.5),
    "repeats": (0.0, 0.05, 0.15, 0.3, 0.5),
}
_SIZES = [len(v) + 1 for v in BINS.values()]
_OFFSETS = np.cumsum([0, *_SIZES[:-1]])
WIDTH = sum(_SIZES)
_CLASSES = np.zeros((5, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, [*b"#$%&*|<>!@~^=+_{}[]\\"]] = True
_CLASSES[2, [*b".,;:?"]] = True
_CLASSES[3, 48:58] = True
_CLASSES[4, [9, 11, 12, 13, 32]] = True


def lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of every statistic of all lines (as columns of a one-hot row), the lines' lengths, and each text's first line, with the end."""
    raw = b"\n".join(texts) + b"\n"
    b = np.frombuffer(raw, np.uint8)
    end = np.flatnonzero(b == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    n = end - start
    sums = [np.concatenate([[0], np.cumsum(c[b], dtype=np.int64)]) for c in _CLASSES]
    upper, symbols, stops, digits, _ = (s[end] - s[start] for s in sums)
    space = _CLASSES[4][b] | (b == 10)
    at = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stop = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    line_of = np.searchsorted(start, at, "right") - 1
    words = np.bincount(line_of, minlength=len(start))
    chars = np.bincount(line_of, stop - at, minlength=len(start))
    # hashes of words and lines: a line seen before in its text, and the share of words equal to one of the four before
    up, down = powers(P1, len(b) + 1), powers(pow(P1, -1, 1 << 64), len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    word, line = mix((total[stop] - total[at]) * down[at]), mix((total[end] - total[start]) * down[start])
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    key = mix(line + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    near = np.zeros(len(word), bool)
    for k in (1, 2, 3, 4):
        near[k:] |= (word[k:] == word[:-k]) & (text_of[line_of[k:]] == text_of[line_of[:-k]])
    repeats = np.bincount(line_of, near, minlength=len(start))
    safe, safe_words = np.maximum(n, 1), np.maximum(words, 1)
    stats = (words, chars / safe_words, upper / safe, symbols / safe, stops / safe, digits / safe, (same & (words > 0)).astype(float), repeats / safe_words)
    cols = np.stack([np.searchsorted(edges, x, "left") + o for (edges, x, o) in zip(BINS.values(), stats, _OFFSETS)], axis=1)
    return cols, n, first


def emissions(cols: np.ndarray, first: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The log-odds of good from a line's own statistics and its neighbours'; w: 3 rows of weights and a bias."""
    own, before, after = (w[k * WIDTH + cols].sum(axis=1) for k in range(3))
    e = own + w[-1]
    e[1:] += before[:-1]
    e[:-1] += after[1:]
    e[first[:-1]] -= np.where(first[:-1] > 0, before[first[:-1] - 1], 0)
    last = first[1:] - 1
    e[last] -= np.where(last + 1 < len(cols), after[np.minimum(last + 1, len(cols) - 1)], 0)
    return e


def _scan(m: np.ndarray) -> np.ndarray:
    """Products m[0] ... m[k] for each k, each scaled by its sum."""
    m, step = m.copy(), 1
    while step < len(m):
        made = np.einsum("nij,njk->nik", m[:-step], m[step:])
        m[step:] = made / made.sum(axis=(1, 2), keepdims=True)
        step *= 2
    return m


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(state of the line before, state of the line) where there is one before."""
    f = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=1)
    f /= f.sum(axis=1, keepdims=True)
    t = np.exp(trans)
    m = t[None] * f[:, None, :]
    m[first[:-1]] = f[first[:-1]][:, None, :]
    alpha = _scan(m).sum(axis=1)
    after = np.concatenate([m[1:], np.ones((1, 2, 2))])[::-1].transpose(0, 2, 1)
    beta = _scan(after)[::-1].sum(axis=1)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    pair = np.zeros((len(e), 2, 2))
    pair[1:] = alpha[:-1, :, None] * t[None] * (f[1:] * beta[1:])[:, None, :]
    pair[first[:-1]] = 0
    return p[:, 1], pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)


class Model:
    def __init__(self) -> None:
        self.w, self.trans = np.zeros(3 * WIDTH + 1), np.zeros((2, 2))

    def line_marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, the lines' lengths, and each text's first line, with the end."""
        cols, n, first = lines(texts)
        return marginals(emissions(cols, first, self.w), first, self.trans)[0], n, first

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's score, its number of lines, and of those that are good."""
        p, n, first = self.line_marginals(texts)
        weight = n + 1e-3
        score = np.clip(np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)
        return score, np.diff(first), np.add.reduceat((p >= 0.5).astype(np.int64), first[:-1])


def relabelled(p: np.ndarray, own: np.ndarray, size: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Line labels: the text's label (own), but for lines whose probability p of being good says otherwise with 70 %; at most half of a text."""
    against = np.where(own > 0, p < 0.3, p > 0.7)
    share = np.bincount(of, against * size, n) / np.maximum(np.bincount(of, size, n), 1e-9)
    return np.where(against & (share[of] <= 0.5), 1 - own, own)


def train(rows: list[tuple[bytes, int, str]], steps: tuple[int, ...] = (40, 15, 15), rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Adam on the conditional log-likelihood, every text with the same weight; lines are given new labels after each number of steps."""
    m, y = Model(), np.array([r[1] for r in rows])
    if not 0 < y.sum() < len(y):
        m.w[-1] = 60 if not len(y) or y.all() else -60
        return m
    some = [lines([r[0] for r in rows[k : k + 100]]) for k in range(0, len(rows), 100)]  # a text's bytes need many times their size
    cols, n = np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[2]) for x in some]))])
    of = np.repeat(np.arange(len(rows)), np.diff(first))
    own, weight = y[of].astype(float), ((n + 1.0) / np.add.reduceat(n + 1.0, first[:-1])[of])
    weight *= np.where(own > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(rows)
    inner = np.ones(len(cols), bool)
    inner[first[:-1]] = False
    gold = own
    s1, s2, t1, t2 = np.zeros_like(m.w), np.zeros_like(m.w), np.zeros((2, 2)), np.zeros((2, 2))
    k = 0
    for turn, count in enumerate(steps):
        if turn:
            gold = relabelled(marginals(emissions(cols, first, m.w), first, m.trans)[0], own, n + 1.0, of, len(rows))
        both = 2 * gold[:-1].astype(int) + gold[1:].astype(int)
        real = np.bincount(both[inner[1:]], weight[1:][inner[1:]], 4).reshape(2, 2)
        for _ in range(count):
            k += 1
            p, pair = marginals(emissions(cols, first, m.w), first, m.trans)
            d = (p - gold) * weight
            back, ahead = np.zeros_like(d), np.zeros_like(d)  # a line's statistics act on the next line and on the one before
            back[:-1], ahead[1:] = np.where(inner[1:], d[1:], 0), np.where(inner[1:], d[:-1], 0)
            g = np.concatenate([*(sum(np.bincount(cols[:, j], x, WIDTH) for j in range(cols.shape[1])) for x in (d, back, ahead)), [d.sum()]]) + l2 * m.w
            if not turn:
                g[WIDTH:-1] = 0
            gt = (pair * weight[:, None, None]).sum(axis=0) - real + l2 * m.trans
            for x, grad, a, b in [(m.w, g, s1, s2), (m.trans, gt, t1, t2)][: 1 + (turn > 0)]:
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                x -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-9)
            np.clip(m.trans, -3, 3, out=m.trans)
    return m


def score(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold), n_lines, n_good_lines (of marginals of a half or more)."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, "quality", per_class, id_col, text_col)))  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.value.scores(some) for _, some in blocks(batch.column(1).to_pylist())] or [(np.zeros(0), np.zeros(0, int), np.zeros(0, int))]
            s, n, good = (np.concatenate(x) for x in zip(*made))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(k) for k in batch.column(0).to_pylist()], pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(n, pa.int64()), pa.array(good, pa.int64())], names=["doc_id", "held_out", "score", "predicted", "n_lines", "n_good_lines"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int, n_lines long, n_good_lines long")
