"""Operators 3, 4, 7 and the pipeline against brute force on small fixtures."""

import collections
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from lumeno.llm import masked_lm, ordermin, substring
from tests.llm.test_simple_ops import ODD, odd


def vocabulary(r, n=300):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


# 4: repeated passages


def brute_removal(texts, width):
    words = [(t or "").encode().split() for t in texts]
    c = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if c[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [5, 35])
def test_repeated_passages_equal_brute_force(spark, width):
    r = random.Random(width)
    voc = vocabulary(r, 40 if width == 5 else 300)
    passages = [[r.choice(voc) for _ in range(r.randint(width - 1, 3 * width))] for _ in range(8)]
    texts = []
    for _ in range(120):
        t = []
        for _ in range(r.randint(0, 4)):
            t += [r.choice(voc) for _ in range(r.randint(0, 40))] + (r.choice(passages) if r.random() < 0.5 else [])
        texts.append(r.choice([" ", "\n", "\t "]).join(t))
    texts += texts[:5] + [x[1] for x in ODD] + ["é x " * 60, passages[0][0]]
    got = {g.doc_id: g for g in substring.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), width, with_text=True).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(brute_removal(texts, width)):
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == want, k
    assert substring.remove_repeats(odd(spark).limit(0)).count() == 0


def test_automaton_matches():
    r = random.Random(1)
    for _ in range(200):
        refs = [[bytes([r.choice(b"abc")]) for _ in range(r.randint(1, 12))] for _ in range(3)]
        a = substring.Automaton()
        for ref in refs:
            a.add(ref)
        text = [bytes([r.choice(b"abcd")]) for _ in range(15)]
        have = {tuple(ref[i : i + 3]) for ref in refs for i in range(len(ref) - 2)}
        assert a.ends(text, 3) == [i for i in range(2, 15) if tuple(text[i - 2 : i + 1]) in have]


# 7: near duplicates


def test_banded_distance_equals_plain():
    r = random.Random(0)
    for _ in range(2000):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 13))] for _ in range(2))
        if r.random() < 0.5:
            b = [x for x in a if r.random() < 0.9]
        most = r.randint(0, 8)
        assert ordermin.banded_distance(a, b, most) == min(edit_distance(a, b), most + 1)


def test_near_duplicates(spark):
    r = random.Random(2)
    voc = vocabulary(r)
    rows, want = [], {}
    for c in range(40):
        base = [r.choice(voc) for _ in range(r.randint(60, 200))]
        for k in range(r.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(len(t) // 60 if k else 0):
                t[r.randrange(len(t))] = "new"
            rows.append((len(rows), (" " if k % 2 else "\n").join(t)))
            want.setdefault(c, []).append(rows[-1][0])
    passage = [r.choice(voc) for _ in range(50)]
    for _ in range(12):  # a shared passage is no copy
        want[len(want)] = [len(rows)]
        rows.append((len(rows), " ".join([r.choice(voc) for _ in range(60)] + passage + [r.choice(voc) for _ in range(60)])))
    got = ordermin.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {g.doc_id: g.class_id for g in got} == {k: min(ks) for ks in want.values() for k in ks}
    assert all(g.class_size == len(next(ks for ks in want.values() if g.doc_id in ks)) for g in got)
    made = ordermin.classes(odd(spark)).collect()
    assert len(made) == len(ODD) and {g.class_id for g in made if g.doc_id in (1, 2, 3)} == {1}
    assert ordermin.classes(odd(spark).limit(0)).count() == 0


def test_classes_are_those_of_all_pairs_with_a_common_key(spark):
    r = random.Random(7)
    voc, texts = vocabulary(r), []
    passage = [r.choice(voc) for _ in range(60)]
    for c in range(12):  # copies are apart from each other (0.76), but not from the original
        base = passage + [r.choice(voc) for _ in range(90)]
        for k in range(5):
            t = list(base)
            for at in range(42 + 18 * k, 60 + 18 * k) if k else []:
                t[at] = f"z{c}.{k}.{at}"
            texts.append(t)
    both = ordermin.Words([" ".join(t).encode() for t in texts])
    keys = [set(x) - {0} for x in ordermin.band_keys(*ordermin.labelled_runs(both.hashes(), both.first)).tolist()]
    want = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if want[a] != want[b] and keys[a] & keys[b] and edit_distance(texts[a], texts[b]) <= 30:
                want = [min(want[a], want[b]) if x in (want[a], want[b]) else x for x in want]
    assert len(set(want)) < 20
    got = ordermin.classes(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()
    assert [g.class_id for g in sorted(got)] == want


def test_only_facts_of_pairs_are_shuffled(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 2}x{j}" for j in range(30)) + f" {k}") for k in range(40)], "doc_id long, text string")
    facts = ordermin.sketch(docs).withColumnRenamed("doc_id", "rid").localCheckpoint()
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 7)], "a long, b long")
    for f, want in ((ordermin.plausible, {(0, 1), (2, 3)}), (ordermin.verify, {(0, 1), (2, 3), (4, 7)})):
        made = f(pairs, facts, 0.8)
        assert {(x.a, x.b) for x in made.collect()} == want
        # Before: the facts of all texts went into the joins.
        assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()


def test_large_buckets_are_divided_by_words_in_common_only(spark):
    # Before: words that no other text has made rows, and buckets with the same texts were compared each.
    words = [["own0", "own1", "all", "all"], ["own2", "own3", "all", "all"], ["own4", "pair", "all", "all"], ["own5", "pair", "all", "all"]]
    docs = spark.createDataFrame([(k, " ".join(w * 5)) for k, w in enumerate(words)], "doc_id long, text string")
    facts = ordermin.sketch(docs).withColumnRenamed("doc_id", "rid").localCheckpoint()
    parts = {}
    for r in ordermin.prefixes(facts.select("rid"), facts, 0.5).collect():
        parts.setdefault(r.part, set()).add(r.rid)
    assert parts and all(len(x) > 1 for x in parts.values()) and {2, 3} in parts.values()
    placed = spark.createDataFrame([(b, k, k // 2) for b, ks in ((1, (1, 2, 3)), (2, (1, 2, 3)), (3, (1, 2, 4)), (4, (2, 3))) for k in ks], "bucket long, rid long, root long")
    made = [r for r in ordermin._mixed(placed, 3).collect()]
    assert sorted(r.n for r in made) == [3, 3] and 3 in {r.bucket for r in made}


def test_links_at_the_threshold_are_found(spark):
    r = random.Random(9)
    voc, texts = vocabulary(r, 3000), []
    for c in range(200):
        n = r.randint(5, 30) if c < 80 else r.randint(31, 250)
        t = [r.choice(voc) for _ in range(n)]
        copy = list(t)
        for k, at in enumerate(sorted(r.sample(range(n), int(n * r.uniform(0.15, 0.2)) if n > 9 else 1), reverse=True)):
            copy[at : at + 1] = [[], [f"z{k}"], [copy[at], f"z{k}"]][r.randrange(3)]
        texts += [t, copy]
    texts += [voc[:8], [*voc[:4], "more", *voc[4:8]]]
    want = [k for k in range(0, len(texts), 2) if edit_distance(*texts[k : k + 2]) <= 0.2 * max(map(len, texts[k : k + 2])) + 1e-9]
    assert len(want) > 150
    got = [g.class_id for g in sorted(ordermin.classes(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect())]
    found = [k for k in want if got[k + 1] == k]
    assert len(found) >= 0.97 * len(want)
    assert all(k in found for k in want if max(map(len, texts[k : k + 2])) <= ordermin.SHORT)
    assert all(got[k + 1] == k + 1 for k in range(0, len(texts), 2) if k not in want)


def test_profiles_rule_out_no_link():
    r = random.Random(8)
    for k in range(400):
        n = r.randint(1, 40) if k < 300 else r.choice([60, 66, 250, 262, 1010, 1040])  # across all borders between profiles
        kinds = r.choice([5, 24, 60])
        a = [r.randint(0, kinds) for _ in range(n)]
        b = [x if r.random() < 0.85 else r.randint(0, kinds) for x in a if r.random() < 0.95] or [0]
        if k >= 300 and k % 2:  # few changes, just over the border
            border = 64 if n < 70 else 256 if n < 300 else 1024
            a = (a * 2)[:border]
            b = [*a[:5], r.randint(0, kinds), *a[5:]]
        both = ordermin.Words([" ".join(map(str, x)).encode() for x in (a, b)])
        p = ordermin.profiles(both.hashes(), both.first)
        one, two = (ordermin.folded([x], min(map(len, p))) for x in p)
        assert ordermin.least_edits(one, two)[0] <= edit_distance(a, b)


@pytest.mark.parametrize("border", [64, 256, 1024])
def test_links_across_borders_of_profiles(spark, border):
    """Few different words, changed in a row: texts with one word more than their copy have a larger profile than it."""
    r = random.Random(border)
    texts = []
    for _ in range(30):
        own = len(texts)
        t = [f"{own}-{r.randrange(24)}" for _ in range(border)]
        at, n = r.randrange(border // 2), border // 6
        texts += [t, [*t[:at], *(f"z{r.randrange(24)}" for _ in range(n)), "more", *t[at + n :]]]
    assert all(edit_distance(*texts[k : k + 2]) <= 0.2 * (border + 1) for k in range(0, min(len(texts), 10), 2))
    got = [g.class_id for g in sorted(ordermin.classes(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect())]
    assert sum(got[k + 1] == got[k] for k in range(0, len(texts), 2)) >= 0.9 * len(texts) / 2


def test_deduplicate_keeps_columns_and_one_row(spark):
    kept = ordermin.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted((x.text or "").strip()[:9] for x in kept.collect()) == sorted(["", "one two t", "same same", "a b c d e", "xxxxxxxxx"])


# 3: language model


def test_language_model_knows_both_sides(spark):
    r = random.Random(3)
    nxt = {w: [f"{w}{k}" for k in range(2)] for w in "abcdefgh"}

    def sentence():
        return " ".join(x for _ in range(40) for w in [r.choice("abcdefgh")] for x in (w, r.choice(nxt[w]), w.upper()))

    texts = [(k, sentence()) for k in range(1500)]
    mixed = texts[0][1].split()
    r.shuffle(mixed)
    rows = texts + [(9000, " ".join(mixed)), (9001, None), (9002, ""), (9003, "unseen words only")]
    got = {g.doc_id: g for g in masked_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), rounds=6).collect()}
    assert len(got) == len(rows) and got[9001].pll == got[9002].pll == 0 and got[9001].n_tokens == 0
    assert got[0].pll > got[9000].pll + 50 and abs(got[0].pll / 120 - got[0].mean_log_prob) < 1e-9
    empty = masked_lm.score(spark.createDataFrame([(1, ""), (2, None), (3, " ")], "doc_id long, text string")).collect()
    assert len(empty) == 3 and all(x.pll == 0 and x.n_tokens == 0 for x in empty)
    assert masked_lm.score(odd(spark)).count() == len(ODD) and masked_lm.score(odd(spark).limit(0)).count() == 0


def test_conditional_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w = {k: rng.normal(0, 0.5, s).astype(np.float32) for k, s in masked_lm.SHAPES.items()}
    ids = np.arange(masked_lm.SIZE)
    ctx = np.tile(rng.integers(0, masked_lm.SIZE, 4), (len(ids), 1))
    assert abs(np.exp(masked_lm.log_probs(ids, ctx, w)).sum() - 1) < 1e-3


# pipeline


def test_pipeline_against_plain_version(spark, tmp_path):
    r = random.Random(4)
    voc = vocabulary(r)
    item = [r.choice(voc) for _ in range(30)]
    rows, labels, kept = [], [], {}

    def add(words, good=True, stays=True, text=None):
        k = len(rows)
        rows.append((k, text if text is not None else "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11)), "en", "s", 0))
        labels.append((k, int(good), 0))
        if stays:
            kept[k] = rows[-1][1]
        return k

    for k in range(160):
        words = [r.choice(voc) for _ in range(r.randint(60, 160))]
        if k % 4 == 0:
            add(words, False, False, " ".join(w.upper() + "!!###" for w in words))
        elif k % 9 == 1:
            add(words[:40] + item + words[40:], stays=False)
        else:
            add(words)
            if k % 10 == 2:
                add([*words[:30], "changed", *words[31:]], stays=False)
    secret = "password=hunter2hunter2"
    k = add([*(r.choice(voc) for _ in range(60)), secret])
    add(["few", "words"], stays=False)
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(0, " ".join(item))], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {x.doc_id: x.text for x in docs.collect()}
    kept[k] = kept[k].replace(secret, "<secret>")
    assert got == kept
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(kept) and corpus_pipeline.ORACLE_SQL is None
