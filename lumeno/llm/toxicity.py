"""Toxicity: a convolutional text classifier in numpy.

Words (lower case, ASCII punctuation cut off) are hashed to buckets with an embedding each. Filters one, two and three
words wide slide over a text; each keeps its largest value, and a logistic unit weighs these. A bucket also stores a
16-bit check of the training word it stands for, so a word that falls there by chance counts as unknown. Every word of two or
more training texts has an embedding, learned in its contexts; its first number starts at how differently toxic and other texts
use the word. Other words are unknown and have the zero embedding. Thresholds by language are cross-checked: the training
rows are dealt to `FOLDS` by their text, a model trained on the other folds scores each, and the threshold of a language is that of its best
F1 in these scores. It gives the column `flagged`; it never changes a score. A language with fewer than 20 rows of either
class has the threshold 0.5.

All labelled rows that aren't held out train the model, its cross-checks and the thresholds. Up to `ON_DRIVER` of them are
trained on the driver. More are dealt by the hash of their id to shards of about `SHARD` rows, which are encoded once: in each round
every shard trains one epoch from the same weights, and these are averaged, an embedding over the shards that changed it. Models that
are trained on other folds share the table of words, but not the counts of their own fold's labels. What reaches the driver (the
table of words, weights, counts of scores by language in fixed steps) is of fixed size for each language. Every text is scored whole.

Defined results: null text is the empty text, whose score is that of no words; null ids count as held out or not by the
empty text's crc32; repeated rows are scored each; without labels of both classes every score is the share of toxic rows
(0 without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumeno.llm.common import held_out, held_out_col, written, zipped
from lumeno.llm.wordhash import Words, blocks

BITS, DIM, FILTERS, WIDTHS, FOLDS = 18, 8, 12, (1, 2, 3), 2
#: Up to so many labelled rows are trained on the driver; of more a shard has about SHARD. Epochs of the model and of the folds' models then.
ON_DRIVER, SHARD, EPOCHS, FOLD_EPOCHS = 7000, 8192, 5, 3
#: Labels that are broadcast to their texts at most.
FEW_LABELS = 1_000_000
#: Rows of a language and class that a threshold takes, and the steps of a score's log odds that its rows are counted in first.
LEAST_ROWS, STEPS = 20, 64
#: Training texts that a word with an embedding stands in.
LEAST_TEXTS = 2
#: Embeddings learn more slowly than filters, as most words say little.
EMB_RATE = 0.2
#: The rate, and what is left of it in the end.
RATE, DECAY = 0.02, 0.3
_CUT = bytes(32 if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128) else c + 32 * (65 <= c < 91) for c in range(256))


def buckets(check: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, and where each text begins, with the end."""
    words = Words([t.translate(_CUT) for t in texts])
    h = words.hashes()
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return np.where(check[at] == (h & np.uint64(0xFFFF)).astype(np.int32), at, 1 << BITS), words.first


class Model:
    def __init__(self, rng: np.random.Generator):
        self.emb = np.zeros(((1 << BITS) + 1, DIM), np.float32)  # the last: unknown
        self.check = np.full(1 << BITS, -1, np.int32)
        self.conv = [rng.normal(0, 0.4, (DIM * w, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out, self.shift = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)
        self.thresholds: dict[str, float] = {}

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return buckets(self.check, texts)

    def known(self, ids: np.ndarray) -> np.ndarray:
        """ids by a table of words that has all of this model's."""
        return np.where(np.append(self.check >= 0, False)[ids], ids, 1 << BITS)

    def learn_words(self, rng: np.random.Generator, h: np.ndarray, n: np.ndarray, sizes: tuple[float, float]) -> None:
        """Words, by hash, that have an embedding, with how many texts of either class (of sizes) have them; in a bucket the last one counts."""
        at, n = (h >> np.uint64(64 - BITS)).astype(np.int64), n.astype(np.float64)
        odds = [np.log((n[k] + 0.5) / (sizes[k] - n[k] + 0.5)) for k in (0, 1)]
        z = (odds[1] - odds[0]) / np.sqrt(sum(1 / (x + 0.5) for x in n))
        self.check[at] = (h & np.uint64(0xFFFF)).astype(np.int32)
        emb = rng.normal(0, 0.01, (len(h), DIM))
        emb[:, 0] = np.where(np.abs(z) >= 2, np.clip(z / 4, -1.5, 1.5), 0.0)  # less is chance
        self.emb[at] = emb

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, *self.bias, self.out, self.shift]

    def pooled(self, ids: np.ndarray, first: np.ndarray, places: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter in each text (at least 0), and, with places, the position that had it (-1: none)."""
        n = len(first) - 1
        best, where = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1)
        own = np.flatnonzero(np.diff(first))
        if not len(own):
            return best, where
        cut, known = first[own], ids != 1 << BITS
        # A row for each filter and each of its words; filters are their rows' sums, each row further to the left.
        parts = np.concatenate([c.reshape(w, DIM, FILTERS).transpose(0, 2, 1).reshape(-1, DIM) for c, w in zip(self.conv, WIDTHS)]) @ self.emb.take(ids, axis=0).T
        # Only positions within reach of a known word can differ from the bias.
        reach, ends, row = known.copy(), np.zeros(len(ids), bool), 0
        for k, w in enumerate(WIDTHS):
            if w > 1:
                reach[: 1 - w] |= known[w - 1 :]
                ends[np.maximum(first[own + 1] - w + 1, cut)] = True
            y = parts[row : row + FILTERS]
            for j in range(1, min(w, len(ids))):
                y[:, :-j] += parts[row + j * FILTERS : row + (j + 1) * FILTERS, j:]
            y += np.where(reach & ~ends, np.float32(0), np.float32(-np.inf))
            row += w * FILTERS
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(y, cut, axis=1).T + self.bias[k]
            best[own, cols] = np.maximum(top, 0)
            if places:
                at = np.stack([y[:, i:j].argmax(axis=1) for i, j in zip(cut, first[own + 1])]) + cut[:, None]
                where[own, cols] = np.where(top > 0, at, -1)
        return best, where

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.scores_of(*self.ids(texts))

    def scores_of(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Some 10,000 words at a time, as many as caches hold."""
        cuts = [0, *(np.flatnonzero(np.diff(first[:-1] // 10_000)) + 1), len(first) - 1] if len(first) > 1 else []
        best = [self.pooled(ids[first[i] : first[j]], first[i : j + 1] - first[i], places=False)[0] for i, j in zip(cuts, cuts[1:])]
        z = np.concatenate([x @ self.out for x in best]) + self.shift[0] if best else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


class Adam:
    """Adam on the logistic loss of a model, whose weights it changes; `touched` are the embeddings that it has changed."""

    def __init__(self, m: Model):
        self.m, self.step, self.params = m, 0, m.params()
        self.first, self.second = ([np.zeros_like(p) for p in self.params] for _ in range(2))
        self.touched = np.zeros(len(m.emb), bool)

    def epoch(self, enc: list[np.ndarray], y: np.ndarray, order: np.ndarray, batch: int, rate: float) -> None:
        """Rows, as the buckets of their words, in this order."""
        m, params, first, second = self.m, self.params, self.first, self.second
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            ids = np.concatenate([enc[k] for k in pick])
            cuts = np.concatenate([[0], np.cumsum([len(enc[k]) for k in pick])])
            best, where = m.pooled(ids, cuts)
            d = (1 / (1 + np.exp(-np.clip(best @ m.out + m.shift, -30, 30))) - y[pick]) / len(pick)
            grads = [np.zeros_like(p) for p in params[1:]]
            grads[-2], grads[-1] = best.T @ d + 1e-4 * m.out, d.sum(keepdims=True)
            back = np.where(where >= 0, d[:, None] * m.out, 0).astype(np.float32)
            rows_at, deltas = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                t, f = np.nonzero(back[:, cols])
                at, g = where[:, cols][t, f], back[:, cols][t, f]
                grads[len(WIDTHS) + k] = np.bincount(f, g, FILTERS).astype(np.float32)
                spread = np.zeros((len(f), FILTERS), np.float32)
                spread[np.arange(len(f)), f] = g
                for j in range(w):
                    grads[k][j * DIM : (j + 1) * DIM] = m.emb[ids[at + j]].T @ spread
                    rows_at.append(ids[at + j])
                    deltas.append(g[:, None] * m.conv[k][j * DIM : (j + 1) * DIM].T[f])
            self.step += 1
            a, b = 1 - 0.9**self.step, 1 - 0.999**self.step
            for p, g, s1, s2 in zip(params[1:], grads, first[1:], second[1:]):
                s1 += 0.1 * (g - s1)
                s2 += 0.001 * (g * g - s2)
                p -= rate * (s1 / a) / (np.sqrt(s2 / b) + 1e-8)
            at, deltas = np.concatenate(rows_at), np.concatenate(deltas)
            if not len(at):
                continue
            order_at = np.argsort(at, kind="stable")
            at = at[order_at]
            new = np.flatnonzero(np.diff(at, prepend=-1))
            at, g = at[new], np.add.reduceat(deltas[order_at], new, axis=0)
            g[at == 1 << BITS] = 0
            first[0][at] += 0.1 * (g - first[0][at])
            second[0][at] += 0.001 * (g * g - second[0][at])
            m.emb[at] -= EMB_RATE * rate * (first[0][at] / a) / (np.sqrt(second[0][at] / b) + 1e-8)
            self.touched[at] = True


def train(rows: list[tuple[bytes, int, str]], epochs: int = 0, batch: int = 64, rate: float = RATE, seed: int = 7) -> Model:
    """Adam on the logistic loss; rows are (text, label, language), and the language is not used. epochs 0: five, or as many as give 400 steps."""
    epochs = epochs or min(60, max(5, 400 * batch // max(1, len(rows))))
    rng = np.random.default_rng(seed)
    m = Model(rng)
    y = np.array([r[1] for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        m.out[:] = 0
        m.shift[0] = 20 if len(y) and y.all() else -20
        return m
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for t, label, _ in rows:
        seen[label].update(set(Words([t.translate(_CUT)]).hashes().tolist()))
    words = sorted((h for h in seen[0].keys() | seen[1].keys() if seen[0][h] + seen[1][h] >= LEAST_TEXTS), key=lambda h: (seen[0][h] + seen[1][h], h))
    m.learn_words(rng, np.array(words, np.uint64), np.array([[seen[k][h] for h in words] for k in (0, 1)]), (len(y) - y.sum(), y.sum()))
    enc = [m.ids([t])[0] for t, _, _ in rows]
    adam = Adam(m)
    for epoch in range(epochs):
        adam.epoch(enc, y, rng.permutation(len(rows)), batch, rate)
        rate *= DECAY ** (1 / epochs)
    return m


def calibrate(m: Model, rows: list[tuple[bytes, int, str]]) -> Model:
    """m with a threshold for each language, from scores of rows by models that were trained on the other folds."""
    fold, scores = np.array([zlib.crc32(r[0]) % FOLDS for r in rows]), np.zeros(len(rows))
    langs, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    enough = [x for x in np.unique(langs) if LEAST_ROWS <= y[langs == x].sum() <= (langs == x).sum() - LEAST_ROWS]
    for f in range(FOLDS) if enough else ():
        other, own = train([r for r, k in zip(rows, fold) if k != f], epochs=3 if len(rows) > 1000 else 0), np.flatnonzero(fold == f)
        for k in range(0, len(own), 200):
            scores[own[k : k + 200]] = other.scores([rows[i][0] for i in own[k : k + 200]])
    m.thresholds = {str(x): best_threshold(scores[langs == x], y[langs == x]) for x in enough}
    return m


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Midway in the gap of scores where F1 is highest."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int, str]]:
    """At most `per_class` training rows of each class: those whose id hashes lowest, of ids that are not held out."""
    marked = labels.where(~held_out_col(F.col(id_col)) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"))
    picked = [marked.where(F.col("_label") == k).orderBy("_h", "_id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), lang.alias("_lang")).join(few, "_id").select("_h", "_id", "_text", "_label", "_lang").collect()
    return [(r["_text"].encode("utf-8", "surrogatepass"), r["_label"], r["_lang"]) for r in sorted(rows, key=lambda r: (r["_h"], r["_id"], r["_text"]))]


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """_h (hash of the id), _id, _text, _label, _lang of all rows that have a label and aren't held out."""
    marked = labels.where(~held_out_col(F.col(id_col)) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"))
    few = marked.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), lang.alias("_lang")).join(F.broadcast(marked) if few else marked, "_id").select("_h", "_id", "_text", "_label", "_lang")
    return rows if few else zipped(rows, "labelled")  # the texts are shuffled once


def word_texts(rows: DataFrame) -> DataFrame:
    """h, n: of each word, by its hash, how many texts of each fold and label have it (fold by fold, label 0 first); each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.concatenate([n for _, n in held])
            return keys, np.stack([np.bincount(inverse, n[:, k], len(keys)) for k in range(2 * FOLDS)], axis=1).astype(np.int64)

        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(n[:, k]) for k in range(2 * FOLDS))], names=["h", *names])

        for batch in batches:
            label = batch.column(1).to_numpy()
            for at, some in blocks(batch.column(0).to_pylist()):
                words = Words([t.translate(_CUT) for t in some])
                h, text = words.hashes(), np.repeat(np.arange(len(some)), words.counts)
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.flatnonzero((np.diff(h, prepend=0) != 0) | (np.diff(text, prepend=-1) != 0)) if len(h) else np.zeros(0, np.int64)
                kind = np.array([zlib.crc32(t) % FOLDS for t in some]) * 2 + label[at : at + len(some)]
                keys, inverse = np.unique(h[new], return_inverse=True)
                n = np.bincount(inverse * 2 * FOLDS + kind[text[new]], minlength=len(keys) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
                held.append((keys, n))
                if len(held) >= 8:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:  # what grows beyond that is summed by the shuffle
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    names = [f"n{k}" for k in range(2 * FOLDS)]
    return rows.select("_text", "_label").mapInArrow(run, f"h long, {', '.join(f'{n} long' for n in names)}").groupBy("h").agg(*[F.sum(n).alias(n) for n in names])


def starts_of(rows: DataFrame, sizes: np.ndarray, seed: int = 7) -> list[Model]:
    """The models before training, the one of all rows first and then each fold's, which counts what is in the others only. sizes: rows of each fold and label.

    Of the words of a bucket that stand in enough texts the most frequent one has the embedding.
    """
    names = [f"n{k}" for k in range(2 * FOLDS)]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    best = word_texts(rows).where(total >= LEAST_TEXTS).groupBy(F.shiftrightunsigned("h", 64 - BITS)).agg(F.max_by(F.struct("h", *names), F.struct(total, "h")).alias("x")).select("x.*")
    found = best.toArrow().sort_by("h")  # as many rows as there are buckets
    h, n = found["h"].to_numpy().view(np.uint64), np.stack([found[c].to_numpy() for c in names]).reshape(FOLDS, 2, -1)
    made = []
    for fold in (None, *range(FOLDS)):
        rng = np.random.default_rng(seed)
        m, own = Model(rng), [f for f in range(FOLDS) if f != fold]
        seen = n[own].sum(axis=0)
        known = seen.sum(axis=0) >= LEAST_TEXTS
        m.learn_words(rng, h[known], seen[:, known], tuple(sizes[own].sum(axis=0)))
        made.append(m)
    return made


def encoded(rows: DataFrame, m: Model, shards: int) -> DataFrame:
    """A row for each shard: of its rows, in order, fold, label, lang and size, and of all of these together ids, the buckets of their words."""
    shared = rows.sparkSession.sparkContext.broadcast(m.check)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = shared.value
        for batch in batches:
            for at, some in blocks(batch.column(4).to_pylist()):
                ids, first = buckets(check, some)
                fold = pa.array([zlib.crc32(t) % FOLDS for t in some], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(some)) for k in (0, 1, 2)), fold, batch.column(3).slice(at, len(some)), batch.column(5).slice(at, len(some)), lists], names=["shard", "h", "digest", "fold", "label", "lang", "ids"])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("h", "digest", "label")])
        ids = t["ids"].combine_chunks()
        columns = {"fold": t["fold"], "label": t["label"], "lang": t["lang"], "size": ids.value_lengths(), "ids": ids.flatten()}
        return pa.table({"shard": t["shard"][:1]} | {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v) for c, v in columns.items()})

    wanted = rows.select(F.pmod("_h", F.lit(shards)).cast("int").alias("shard"), "_h", F.xxhash64("_text").alias("digest"), "_label", "_text", "_lang")
    made = wanted.mapInArrow(encode, "shard int, h long, digest long, fold int, label int, lang string, ids array<int>")
    return made.groupBy("shard").applyInArrow(pack, "shard int, fold array<int>, label array<int>, lang array<string>, size array<int>, ids array<int>")


def one_round(shards: DataFrame, models: list[Model], epoch: int, batch: int = 64, seed: int = 7) -> None:
    """An epoch of training for the models that have one left: each shard begins at their weights, which become the shards' averages, weighed by rows."""
    epochs = [EPOCHS] + [FOLD_EPOCHS] * FOLDS
    now = [k for k in range(len(models)) if epoch < epochs[k]]
    shared = shards.sparkSession.sparkContext.broadcast({k: (models[k].check, models[k].params()) for k in now})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (b.slice(i, 1) for b in batches for i in range(len(b))):
            shard, (fold, label, size, flat) = t.column(0)[0].as_py(), (t.column(k).flatten().to_numpy() for k in (1, 2, 3, 4))
            first, label = np.concatenate([[0], np.cumsum(size)]), label.astype(np.float32)
            for k, (check, weights) in shared.value.items():
                own = np.flatnonzero(fold != k - 1)  # the first model learns from all folds
                if not len(own):
                    continue
                m = Model(np.random.default_rng(seed))
                for mine, given in zip(m.params(), weights):
                    mine[:] = given
                m.check = check
                adam = Adam(m)
                enc = [m.known(flat[first[i] : first[i + 1]]) for i in own]
                adam.epoch(enc, label[own], np.random.default_rng([seed, epoch, shard]).permutation(len(own)), batch, RATE * DECAY ** (epoch / epochs[k]))
                at = np.flatnonzero(adam.touched[: 1 << BITS])
                rest = np.concatenate([p.ravel() for p in m.params()[1:]])
                rest = np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)
                v = np.concatenate([m.emb[at], rest])
                at = np.concatenate([at, (1 << BITS) + np.arange(len(rest))])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), float(len(own)))), *(pa.array(v[:, j]) for j in range(DIM))], names=names)

    names = ["model", "at", "w", *(f"v{j}" for j in range(DIM))]
    parts = shards.select("shard", "fold", "label", "size", "ids").mapInArrow(run, f"model int, at int, w double, {', '.join(f'{c} float' for c in names[3:])}")
    mean = parts.groupBy("model", "at").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).cast("float").alias(c) for c in names[3:]]).toArrow()  # as many rows as the models have buckets
    model, at, v = mean["model"].to_numpy(), mean["at"].to_numpy(), np.stack([mean[c].to_numpy() for c in names[3:]], axis=1)
    for k in now:
        emb, rest = (model == k) & (at < 1 << BITS), (model == k) & (at >= 1 << BITS)
        models[k].emb[at[emb]] = v[emb]
        flat = v[rest][np.argsort(at[rest])].ravel()
        for p in models[k].params()[1:] if len(flat) else ():
            p[:] = flat[: p.size].reshape(p.shape)
            flat = flat[p.size :]
    shared.unpersist()


def cross_scores(shards: DataFrame, models: list[Model]) -> DataFrame:
    """lang, label, score of all rows of the shards, by the model of their fold."""
    shared = shards.sparkSession.sparkContext.broadcast(models[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (b.slice(i, 1) for b in batches for i in range(len(b))):
            fold, size, flat = (t.column(k).flatten().to_numpy() for k in (0, 3, 4))
            first, made = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(fold))
            for f, m in enumerate(shared.value):
                own = np.flatnonzero(fold == f)
                for some in np.split(own, range(500, len(own), 500)):
                    if len(some):
                        ids = np.concatenate([flat[first[i] : first[i + 1]] for i in some])
                        made[some] = m.scores_of(m.known(ids), np.concatenate([[0], np.cumsum(size[some])]))
            yield pa.RecordBatch.from_arrays([t.column(2).flatten(), t.column(1).flatten(), pa.array(made)], names=["lang", "label", "score"])

    return shards.select("fold", "label", "lang", "size", "ids").mapInArrow(run, "lang string, label int, score double")


def thresholds(scored: DataFrame) -> dict[str, float]:
    """best_threshold of all rows (lang, label, score) of each language that has enough of both classes.

    Equal scores are counted once, and steps of the log odds first, so that each step's scores need the sums of the higher steps only.
    """
    step = F.floor(STEPS * (F.log(F.greatest("score", F.lit(1e-300))) - F.log(F.greatest(1 - F.col("score"), F.lit(1e-17)))))
    counts = written(scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).withColumn("step", step), "scores")
    whole = Window.partitionBy("lang")
    down, within = whole.orderBy(F.desc("step")), Window.partitionBy("lang", "step").orderBy(F.desc("score"))
    steps = counts.groupBy("lang", "step").agg(F.sum("n").alias("of"), F.sum("hits").alias("of_hits"), F.max("score").alias("top"))
    steps = steps.select("lang", "step", (F.sum("of").over(down) - F.col("of")).alias("n0"), (F.sum("of_hits").over(down) - F.col("of_hits")).alias("hits0"), F.lead("top").over(down).alias("next"), F.sum("of").over(whole).alias("all"), F.sum("of_hits").over(whole).alias("all_hits"))
    rows = counts.join(steps.where((F.col("all_hits") >= LEAST_ROWS) & (F.col("all") - F.col("all_hits") >= LEAST_ROWS)), ["lang", "step"])
    f1 = 2 * (F.col("hits0") + F.sum("hits").over(within)) / (F.col("n0") + F.sum("n").over(within) + F.col("all_hits"))
    below = F.coalesce(F.lead("score").over(within), "next", F.lit(0.0))
    best = rows.select("lang", "score", below.alias("below"), f1.alias("f1")).groupBy("lang").agg(F.max_by(F.struct("score", "below"), F.struct("f1", "score")).alias("x"))
    return {r["lang"]: (r["x"]["score"] + r["x"]["below"]) / 2 for r in best.collect()}  # a row for each language


def fit(rows: DataFrame, n: int) -> Model:
    """The model of all n labelled rows, with its thresholds."""
    if n <= ON_DRIVER:
        few = [(r["_text"].encode("utf-8", "surrogatepass"), r["_label"], r["_lang"]) for r in sorted(rows.collect(), key=lambda r: (r["_h"], r["_id"], r["_text"]))]
        return calibrate(train(few), few)
    sizes = np.zeros((FOLDS, 2), np.int64)
    for r in rows.groupBy(F.pmod(F.crc32(F.col("_text").cast("binary")), F.lit(FOLDS)).alias("fold"), "_label").count().collect():
        sizes[r["fold"], r["_label"]] = r["count"]
    if not sizes.sum(axis=0).all():
        return train([(b"", 1, "")] if sizes[:, 1].any() else [(b"", 0, "")])
    models = starts_of(rows, sizes)
    shards = zipped(encoded(rows, models[0], -(-n // SHARD)), "shards")
    for epoch in range(max(EPOCHS, FOLD_EPOCHS)):
        one_round(shards, models, epoch)
    models[0].thresholds = thresholds(cross_scores(shards, models))
    return models[0]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (of the language), flagged."""
    rows = labelled(docs, labels, "toxic", id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, rows.count()))  # its size is fixed by BITS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            ids, texts, langs = (batch.column(k).to_pylist() for k in range(3))
            parts = [m.scores(some) for _, some in blocks(texts)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            t = np.array([m.thresholds.get(x or "", 0.5) for x in langs], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(k) for k in ids], pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(t), pa.array(s >= t)], names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"])

    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int, threshold double, flagged boolean")
