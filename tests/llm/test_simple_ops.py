"""Operators 1, 2, 5, 6, 8, 9, 10 against plain Python and planted cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumeno.llm import crf, decontam, packing, rules, secrets, toxicity, warc
from lumeno.llm.common import held_out

DOCS = "doc_id long, text string, lang string, extra string, n_words long, _w string"
ODD = [
    (1, "", "en", "x", 1, "y"),
    (2, None, "en", None, 2, None),
    (None, "one two three", None, "x", 3, "y"),
    (3, " \n\t ", "en", "x", 4, "y"),
    (4, "same same", "en", "x", 5, "y"),
    (4, "same same", "en", "x", 5, "y"),
    (5, "a b c d e f g h i j " * 4000, "de", "x", 6, "y"),
    (6, "x" * 50_000, "fr", "x", 7, "y"),
]
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and", "river", "stone", "light", "house", "green", "paper", "wind", "walks", "slowly", "seven", "birds"]) for _ in range(n))


# 5: packing


def test_packing_plan_is_valid_and_matches_large_items():
    r = random.Random(3)
    for _ in range(30):
        counts = collections.Counter(r.choice([100, r.randint(1, 100), r.randint(1, 12)]) for _ in range(r.randint(1, 300)))
        made, placed = packing.plan(counts, 100), collections.Counter()
        for pattern, n in made:
            assert n > 0 and sum(a * b for a, b in pattern) <= 100 and sum(b for a, b in pattern if 3 * a > 100) <= 2
            for a, b in pattern:
                placed[a] += b * n
        assert placed == counts
        assert sum(n for _, n in made) >= -(-sum(a * b for a, b in counts.items()) // 100)
    assert sum(n for _, n in packing.plan({60: 5, 40: 5, 34: 2, 33: 3}, 100)) == 7


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing_equals_plain_tokens_and_fills_sequences(spark, capacity):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, r = Tokenizer.from_file(path), random.Random(1)
    texts = [x[1] for x in ODD] + ["It's <|endoftext|> I'LL Ünïcode é Σσ  x y z_9", "ǅ ǆ ﬁ ½ ٣ 中文字 🙂🙂 don't"] + ["".join(r.choice("ab Zé'!1_\n") for _ in range(40)) for _ in range(60)]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), path, capacity=capacity).collect()
    want = {}
    for k, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s : s + capacity], "<u4")
            want[k, p] = (s, len(part), zlib.crc32(part.tobytes()))
    assert {(g.doc_id, g.piece): (g.start, g.length, g.ids_crc32) for g in got} == want and len(got) == len(want)
    bins = collections.defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= capacity


def test_packing_of_an_empty_table(spark):
    assert packing.pack(odd(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 6: secrets


def plain_base(t):
    out = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_secrets_equal_plain_patterns(spark):
    r = random.Random(5)
    bits = ["password", "PassWd", "api_key", "APIKEY", "secret", "token", "=", ": ", ' = "', "'", "abcdef12", "é", " ", "\n", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "f" * 31, "K8", "ſecret"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(400)] + [x[1] for x in ODD]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(rows) == len(texts)
    for g in rows:
        want = plain_base(texts[g.doc_id] or "")
        assert [g.n_assign, g.n_access, g.n_hex] == [sum(w[0] == k for w in want) for k in secrets.KINDS[:3]]
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [s for s in g.spans.split(",") if s and not s.startswith("token")] == [f"{k}:{a}:{b}" for k, a, b in want]


def test_secrets_by_token_efficiency(spark):
    found = "xQ7vK2mZp9LrT4wBn8sYc3Hd"
    clean = ["123e4567-e89b-12d3-a456-426614174000", "/usr/local/share/python3/documentation", "the_quick_brown_fox_2024", "D41D8CD98F00B204E9800998ECF8427E", "Internationalization"]
    t = " ".join(clean) + f" ({found})"
    g = secrets.scan(spark.createDataFrame([(1, t)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).first()
    assert g.spans == f"token:{t.index(found)}:{t.index(found) + len(found)}" and g.redacted == t.replace(found, "<secret>")


# 1: toxicity, 9: quality


def labelled(r, n):
    rows = []
    for k in range(n):
        bad = k % 3 == 0
        t = prose(r, r.randint(5, 80)).split()
        if bad:
            t.insert(r.randint(0, len(t)), r.choice(["blorg", "Snarf!", "gronk,"]))
        rows.append((k, " ".join(t), "en" if k % 2 else "de", int(bad)))
    return rows


def test_toxicity_held_out_and_odd_rows(spark):
    rows = labelled(random.Random(2), 900)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxicity.score(docs, labels).collect()}
    out = [r for r in rows if held_out(r[0])]
    assert all(got[r[0]].held_out for r in out) and len(out) > 100
    assert np.mean([got[r[0]].predicted == r[3] for r in out]) > 0.98
    made = toxicity.score(odd(spark), labels).collect()
    assert len(made) == len(ODD) and all(0 <= g.score <= 1 for g in made)
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0
    moved = {g.doc_id: g.score for g in toxicity.score(docs.withColumn("lang", F.lit("zz")), labels).collect()}
    assert all(abs(moved[k] - got[k].score) < 1e-12 for k in moved)


def junk(r, n):
    return "\n".join(" ".join(w.upper() + "!!" for w in prose(r, 8).split()) for _ in range(n))


def test_quality_held_out_and_odd_rows(spark):
    r = random.Random(4)
    rows = [(k, junk(r, r.randint(2, 9)) if k % 4 == 0 else "\n".join(prose(r, 9).capitalize() + "." for _ in range(r.randint(2, 9))), int(k % 4 != 0)) for k in range(500)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    got = {g.doc_id: g for g in crf.score(docs, labels).collect()}
    assert np.mean([got[x[0]].predicted == x[2] for x in rows if held_out(x[0])]) > 0.98
    made = crf.score(odd(spark), labels).collect()
    assert len(made) == len(ODD) and all(0 <= g.score <= 1 for g in made)
    assert crf.score(docs.limit(0), labels.limit(0)).count() == 0


def test_crf_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    sizes, trans = [1, 4, 6, 2], rng.normal(0, 1, (2, 2))
    first = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.normal(0, 1, first[-1])
    p, pair = crf.marginals(e, first, trans)
    for a, b in zip(first[:-1], first[1:]):
        total, one, two = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for ys in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e[a + k] * y for k, y in enumerate(ys)) + sum(trans[x, y] for x, y in itertools.pairwise(ys)))
            total += w
            one += w * np.array(ys)
            for k in range(1, b - a):
                two[k, ys[k - 1], ys[k]] += w
        assert np.allclose(p[a:b], one / total) and np.allclose(pair[a + 1 : b], two[1:] / total)


# 10: rules


def plain_stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


def test_rule_statistics_equal_plain_counts(spark):
    r = random.Random(6)
    texts = [x[1] for x in ODD] + ["".join(r.choice(["a", "b", "é ", " ", "\n", "\x0b", "\x1c", "🙂", "#|", "a b a "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    got = rules.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for g in got:
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == plain_stats(texts[g.doc_id]), texts[g.doc_id]


def test_rules_learn_and_keep_clean_rows(spark):
    r = random.Random(8)
    rows = [(k, junk(r, 8) if k % 4 == 0 else "\n".join(prose(r, 12).capitalize() + "." for _ in range(7)), int(k % 4 != 0)) for k in range(300)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    got = {g.doc_id: g for g in rules.judge(docs, labels).collect()}
    good = [x[0] for x in rows if x[2] and not got[x[0]].base_failed]
    assert np.mean([got[k].kept for k in good]) > 0.98 and not any(got[x[0]].kept for x in rows if not x[2])
    made = rules.judge(odd(spark), labels, carry=True).collect()
    assert len(made) == len(ODD) and sorted(str(g._row) for g in made) == sorted(str(x) for x in odd(spark).collect())
    assert rules.judge(docs.limit(0), labels.limit(0)).count() == 0
    assert rules.learn([]) == []


# 2: WARC


def test_warc_round_trip(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/", big), (2, "http://b/", big), (9, None, big), (4, "http://c/\r\nX: y", small), (5, "", small), (6, "u", None), (7, "u", ""), (8, "u", "z" * 3_000_000), (None, "u", big), (3, "u", "a\r\n\r\nWARC/1.1\r\n" * 90)]
    got = {g.page_id: g for g in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for k, _, h in rows:
        b = (h or "").encode()
        again = h == big and k != 9
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None)
    assert warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    import io

    a = warc.member(warc.record("response", "urn:x-page:1", "u", b"hello"))
    assert [b for _, b in warc.records(io.BytesIO(a + a))] == [b"hello"] * 2
    bad = warc.record("response", "urn:x-page:1", "u", b"hello")
    for x in (a[:-3], warc.member(bad.replace(b"hello", b"jello")), warc.member(bad.replace(b"Content-Length: 5", b"Content-Length: 4")), warc.member(b"nothing")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(x)))


# 8: decontamination


def test_decontamination_tolerates_changes(spark):
    r = random.Random(9)
    voc = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    some = lambda n: [r.choice(voc) for _ in range(n)]
    items = [(k, some(r.randint(15, 60))) for k in range(30)]
    docs, want = [], set()
    for k in range(200):
        t = some(r.randint(0, 300))
        if k % 4 == 0:
            i, w = items[k % 30]
            w = list(w)
            for x in range(3, len(w), 9):
                w[x] = "changed"
            if k % 8 == 0:
                w = w[: max(15, len(w) // 2)]
            if len(w) >= min(24, len(items[k % 30][1])):
                want.add((k, i))
            t = t[:50] + [x.title() + "," for x in w] + t[50:]
        docs.append((k, " ".join(t)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(99, None), (98, "too short")], "item_id long, text string")
    got = decontam.overlaps(spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string"), bench)
    pairs = {(g.doc_id, g.item_id) for g in got.collect()}
    assert want <= pairs and {k for k, _ in pairs} <= {k for k, _ in docs if k % 4 == 0}
    assert decontam.overlaps(odd(spark).limit(0), bench).count() == 0 and decontam.overlaps(odd(spark), bench.limit(0)).count() == 0
    assert decontam.overlaps(odd(spark), bench).count() == 0


def test_decontamination_in_several_passes(spark, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(10)], "item_id long, text string")
    docs = bench.select(F.col("item_id").alias("doc_id"), "text")
    monkeypatch.setattr(decontam, "SEEDS", 50)
    assert sorted((g.doc_id, g.item_id) for g in decontam.overlaps(docs, bench).collect()) == [(k, k) for k in range(10)]


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Beyond what the driver trains, thresholds come from all rows too, and no partitioning changes scores."""
    monkeypatch.setattr(toxicity, "ON_DRIVER", 200)
    monkeypatch.setattr(toxicity, "SHARD", 300)
    seen = []
    monkeypatch.setattr(toxicity, "thresholds", lambda scored, made=toxicity.thresholds: seen.append(scored.collect()) or made(scored))
    rows = labelled(random.Random(5), 1500)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    got = {g.doc_id: g for g in toxicity.score(docs, labels).collect()}
    assert np.mean([got[r[0]].predicted == r[3] for r in rows if held_out(r[0])]) > 0.98
    own = [r for r in rows if not held_out(r[0])]
    assert sorted((x.lang, x.label) for x in seen[0]) == sorted((r[2], r[3]) for r in own)
    for lang in ("en", "de"):
        part = [x for x in seen[0] if x.lang == lang]
        want = toxicity.best_threshold(np.array([x.score for x in part]), np.array([x.label for x in part]))
        assert all(abs(got[r[0]].threshold - want) < 1e-9 for r in rows if r[2] == lang)
    again = {g.doc_id: g.score for g in toxicity.score(docs.repartition(7), labels).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-5 for k in again)


def test_thresholds_of_ties_and_ends(spark):
    r = random.Random(9)
    rows = [(lang, int(r.random() < p), p) for lang, n in (("a", 400), ("b", 300), ("c", 21)) for _ in range(n) for p in [r.choice([0.0, 1e-20, 0.001, 0.3, 0.3001, 0.5, 0.9, 0.99, 1.0] if lang == "a" else [r.random()])]]
    got = toxicity.thresholds(spark.createDataFrame(rows, "lang string, label int, score double"))
    assert set(got) == {"a", "b"}
    for lang in got:
        part = [x for x in rows if x[0] == lang]
        assert got[lang] == toxicity.best_threshold(np.array([x[2] for x in part]), np.array([x[1] for x in part]))
