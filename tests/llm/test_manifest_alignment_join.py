"""Operators 11 to 13 against brute force on small fixtures."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lumeno.llm import crosstok, merkle, parity
from tests.llm.test_simple_ops import DOCS, ODD, odd


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11: Merkle manifest


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text), ids unique in a source."""

    def leaf(row):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(leaves):
        """The levels of a tree and for each leaf its siblings, left and right, on every level."""
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        paths = []
        for k in range(len(leaves)):
            path = []
            for level in levels[:-1]:
                lo = k - k % 3
                path.append(("".join(level[lo:k]), "".join(level[k + 1 : lo + 3])))
                k //= 3
            paths.append(path)
        return levels[-1][0], paths

    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[1]].append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: sorted(sources[s], key=lambda r: (r[0] is not None, r[0])) for s in order}
    trees = {s: tree([leaf(r) for r in made[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for row, path in zip(made[s], trees[s][1]):
            path = path + top
            tampered = row
            if zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                tampered = (*row[:4], row[4].replace("\n", ""))
            end = leaf(tampered)
            for left, right in path:
                end = sha(left, end, right)
            out.append((row[0], leaf(row), trees[s][0], root, sha(*(x for step in path for x in step)), end, end == root))
    return out


@pytest.mark.parametrize("n,n_sources,rows_a_part,fan", [(1, 1, 100, 4), (2, 2, 1, 2), (60, 7, 5, 2), (300, 3, 11, 3), (200, 150, 9, 4), (100, 1, 1000, 256)])
def test_manifest_equals_brute_force(spark, monkeypatch, n, n_sources, rows_a_part, fan):
    monkeypatch.setattr(merkle, "ROWS", rows_a_part)
    monkeypatch.setattr(merkle, "FAN", fan)
    r = random.Random(n)
    names = [None, "", "é", "z", "Z", *(f"s{k}" for k in range(200))][:n_sources]
    weights = [n if k == 1 else 1 for k in range(len(names))]  # one source holds most rows
    rows = [(k * 7 if k else None, names[k] if k < len(names) else r.choices(names, weights)[0], r.choice([None, "en"]), r.choice([None, k]), r.choice([None, "", "a\nb\n", "plain", "ü\n" * 50])) for k in range(n)]
    frame = spark.createDataFrame([(a, b, c, d, e, "x") for a, b, c, d, e in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    got = [tuple(x) for x in merkle.manifest(frame).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_odd_rows(spark):
    table = odd(spark).withColumnsRenamed({"extra": "source", "n_words": "n_chars"})
    got = merkle.manifest(table).collect()
    assert len(got) == len(ODD) and len({x.root for x in got}) == 1
    assert {x.leaf for x in got if x.doc_id == 4} and len([x for x in got if x.doc_id == 4]) == 2
    assert merkle.manifest(table.limit(0)).count() == 0


def test_forests_add_in_any_order():
    r = random.Random(5)
    for _ in range(60):
        sizes = [r.randint(1, 40) for _ in range(r.randint(1, 12))]
        nodes = [((t, 0, k), sha(f"{t}-{k}"), n) for t, n in enumerate(sizes) for k in range(n)]
        whole = merkle.Forest(len(sizes)).add(nodes)
        assert len(whole.open) == 1 and next(iter(whole.open))[0] == merkle.TOP
        r.shuffle(nodes)
        parts = [merkle.Forest(len(sizes)).add(nodes[k::4]) for k in range(4)]
        while len(parts) > 1:
            a, b = parts.pop(r.randrange(len(parts))), parts.pop(r.randrange(len(parts)))
            parts.append(merkle.Forest(len(sizes)).add((k, f.nodes[k], f.sizes[k[0]]) for f in (a, b) for k in f.open))
        assert [parts[0].nodes[k] for k in parts[0].open] == [whole.nodes[k] for k in whole.open]


# 12: alignment of tokenizers


A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    chars = crosstok.byte_level()
    docs = []
    for t in texts:
        ids_a, ids_b = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        raw_a = [bytes(chars[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            docs.append(None)
            continue
        spans = []
        for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
            at, own = 0, []
            for i, x in zip(ids, raw):
                own.append((at, at + len(x), i))
                at += len(x)
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        common = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = ["|".join(",".join(str(x[2]) for x in own if lo < x[1] <= hi) for own in spans) for lo, hi in zip([0, *common], common)]
        docs.append((len(ids_a), len(ids_b), links, groups))
    counts = collections.Counter(x for d in docs if d for x in set(d[2]))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[3]), len(d[2]), sum(counts[x] == best[x[0]] for x in d[2]), sum(counts[x] for x in d[2]), sha(";".join(d[3]))) for d in docs]


@pytest.mark.parametrize("block,bucket", [(25_000_000, 200_000), (300, 20)])
def test_alignment_equals_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(crosstok, "BUCKET", bucket)
    r = random.Random(block)
    odd_chars = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "▁", "\x00", "﻿", "é", "中文", "🙂", "'s", "<s>", "<|endoftext|>", "<0x0A>", "123", "!!", "don't", "ﬁ", "İ", "é"]
    texts = [x[1] if len(x[1] or "") < 20_000 else x[1][:3000] for x in ODD] + [None, "", " ", "  ", "\n", "▁", "a▁b", " lead", "trail ", "trail\n\n", "a \n b", "a\n  b"]
    texts += ["".join(r.choice([*odd_chars, "word", " the", " of", "ing", "x"]) for _ in range(r.randint(1, 40))) for _ in range(150)]
    texts += [" ".join(r.choice(["alignment", "of", "tokenizers", "größe", "naïve", "ξένος", "42"]) for _ in range(30)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    if block < 1000:
        frame = frame.selectExpr("doc_id", "text", "1 AS n_a", "2 AS block")
    got = {x.doc_id: tuple(x)[1:] for x in crosstok.align(frame, A_PATH, B_PATH).collect()}
    want = brute_alignment(texts)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        assert got[k] == w, (k, texts[k])


def test_alignment_of_odd_tables(spark):
    assert crosstok.align(odd(spark), A_PATH, B_PATH).count() == len(ODD)
    assert crosstok.align(odd(spark).limit(0), A_PATH, B_PATH).count() == 0
    none = crosstok.align(spark.createDataFrame([(1, ""), (None, None)], "doc_id long, text string"), A_PATH, B_PATH).collect()
    assert sorted(tuple(x)[1:] for x in none) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_blocks_hold_all_texts():
    """Texts over several blocks keep their ids, whatever batches and blocks they come in."""
    cutter = crosstok.Cutter(" \n\t")
    for text in ["a b", " a  b\n c ", "x y z", "x  y", "\r\nq w", "a\x1c b"]:
        assert "".join(cutter.segments(text)) == " " + text
    assert crosstok.cut_spaces([b" a", b"\n\n"], [b" a", b";\r", b"  "]) == " \n\t\x0b\x0c"
    assert crosstok.cut_spaces([b" \xc2\xa0 ", b"\xa0x"], []) == crosstok.CANDIDATES and " " not in crosstok.cut_spaces([b"\xa0 "], [])
    assert set(" \n\t") <= set(crosstok.pair(A_PATH, B_PATH).spaces)
    assert crosstok.cut_spaces([b"a b"], []) == "\n\t\r\x0b\x0c" and crosstok.cut_spaces([], [b" \n"]) == " \t\r\x0b\x0c"


def test_squeezed_numbers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        v = rng.integers(0, 1 << 24, n)
        assert (crosstok.unsqueezed(crosstok.squeezed(v)) == v).all()


# 13: Jaccard join


def shingle_set(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = lower.encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        words[at : at + 1] = r.choice([[], ["new%d" % r.randrange(99)], [words[at], "more"]])
    return words


@pytest.mark.parametrize("side", [512, 3])
def test_join_equals_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(parity, "SIDE", side)
    r = random.Random(side)
    voc = ["w%d" % k for k in range(400)]
    texts = [x[1] for x in ODD if len(x[1] or "") < 10_000] + ["One TWO three", "one two THREE", "É x", "é x", "a", "A", "a b c d e", "A b C d e "]
    for n in (4, 5, 6, 9, 15, 40, 66, 70, 72, 80, 130, 132, 140, 260, 300, 600):
        for _ in range(6):
            base = [r.choice(voc) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(r.randint(1, 4)):
                base = edited(r, base, r.randint(0, max(1, n // 40)))
                texts.append(" ".join(base).upper() if r.random() < 0.2 else "\t".join(base))
            texts.append(" ".join([*base, *(f"end{k}" for k in range(n // 4))]))  # at the threshold or near it
    passage = [r.choice(voc) for _ in range(60)]
    texts += [" ".join([*passage, *(r.choice(voc) for _ in range(r.randint(10, 30)))]) for _ in range(40)]
    texts += texts[20:25]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rid int, component_id string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity.join(frame).collect()}
    want = brute_components(rows)
    assert len(set(v[1] for v in want.values())) < 0.7 * len(want)
    assert got == want


def test_runs_of_one_set_only_are_no_keys(spark):
    passage = ["w%d" % k for k in range(40)]
    texts = [" ".join([*passage, *("own%d_%d" % (k, j) for j in range(20 + k % 7))]) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " end", texts[1] + " end"])), "doc_id long, text string")
    facts = parity.sketch(docs, "doc_id", "text", 80).selectExpr("doc_id AS rid", "n_shingles", "profile", "words")
    held = {r.rid: parity.runs_of(r.words) for r in facts.collect()}
    made = parity.prefixes(facts.selectExpr("rid", "rid AS root").repartition(5), facts, 80).collect()
    n = collections.Counter(g for x in held.values() for g in x.view(np.int64).tolist())
    assert {x.rid for x in made if n[x.bucket] > 1} >= {0, 60, 1, 61}  # pairs that are linked still share a key
    assert {x.bucket for x in made if x.rid == 0} & {x.bucket for x in made if x.rid == 60}
    # Before: a fifth of all runs, nearly all of one set only.
    assert sum(n[x.bucket] == 1 for x in made) <= 5 < sum(len(x) // 5 for x in held.values()) // 10


def test_join_of_odd_rows(spark):
    got = parity.join(odd(spark)).collect()
    assert len(got) == len(ODD) and all(x.n_shingles == 0 and x.component_id == x.doc_id for x in got if x.doc_id in (1, 2, 3))
    assert parity.join(odd(spark).limit(0)).count() == 0
    none = parity.join(spark.createDataFrame([(1, ""), (2, None), (3, " ")], DOCS.split(",")[0] + ", text string")).collect()
    assert sorted(tuple(x) for x in none) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_sketches_bound_differences_across_sizes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(0, 300), np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(1, 200), np.uint64)])) for _ in range(2))
        raw = [parity.parity(a), parity.parity(b)]
        x, y = (parity.halved([s], min(map(len, raw))) for s in raw)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    for n in [1, 2, 5, 9, 20, 63, 64, 65, 79, 80, 127, 128, 150, 255, 256, 300, 700, 2000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
            k = rng.integers(0, n // 5 + 1)
            gone = rng.choice(len(a), min(k, len(a)), replace=False)
            b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1), np.uint64) * np.uint64(2) + np.uint64(1)]))
            common = len(np.intersect1d(a, b))
            if not common or 100 * common < 80 * (len(a) + len(b) - common):
                continue
            key, text = parity.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert set(key[text == 0].tolist()) & set(key[text == 1].tolist()), n
