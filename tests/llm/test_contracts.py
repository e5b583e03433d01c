"""What the pipeline's stages and the operators do with odd tables, and plain versions of what they find."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lumeno.llm import common, crf, decontam, masked_lm, ordermin, packing, substring, toxicity, warc
from lumeno.llm.wordhash import Words

from .test_group_ops import edit_distance


def vocabulary(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables: repeated rows, null and empty texts, a null id, and columns whose names operators might use."""
    path, r = str(tmp_path_factory.mktemp("tables")), random.Random(4)
    voc = vocabulary(r, 500)
    docs = [(k, " ".join(r.choice(voc) for _ in range(80)), "x", k, k) for k in range(30)]
    docs += [(30, docs[0][1], "x", 0, 0), (31, docs[0][1], "x", 0, 0), (32, None, None, None, None), (33, "", "", 1, 1), (None, docs[5][1] + " more", "y", 2, 2), (7, docs[7][1], "again", 3, 3)]
    docs.append((34, docs[1][1] + " password = hunter2hunter2", "x", 4, 4))
    docs.append((35, docs[2][1] + " " + " ".join(f"item{k}" for k in range(20)), "x", 4, 4))
    docs.append((36, " ".join(r.choice(voc) for _ in range(30_000)), "long", 4, 4))
    spark.createDataFrame(docs, "doc_id long, text string, _row string, _only int, rid int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20))), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_with_odd_rows(spark, tables):
    docs = common.table(spark, tables, "documents")
    expected = {"quality_rules": 37, "near_duplicates": 31, "decontamination": 30, "secret_scan": 30}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, tables), "stage")
        assert docs.columns == ["doc_id", "text", "_row", "_only", "rid"] and docs.count() == expected[name]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {1, 34} & set(texts) and not {2, 35} <= set(texts) and "hunter2hunter2" not in texts.get(1, "") + texts.get(34, "") and len(texts[36].split()) == 30_000
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert packed.where("piece = 0").count() == 30


def test_stages_with_empty_tables(spark, tables):
    empty = common.table(spark, tables, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("a/b c", "some words"), (None, "some"), ("", "more words here")], "doc_id string, text string")
    import public_tokenizers

    made = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {x.doc_id for x in made} == {"a/b c", None, ""}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x/").alias("url"), F.repeat("text", 400).alias("html"))
    both = pages.union(pages.where("page_id = ''").select(F.lit("z").alias("page_id"), "url", "html"))
    got = {x.page_id: (x.record_type, x.refers_to) for x in warc.round_trip(both).collect()}
    assert got == {"a/b c": ("response", None), None: ("response", None), "": ("revisit", "z"), "z": ("response", None)}


def test_equal_page_ids_are_written_each(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1500), (1, "u", "x" * 1500), (0, "u", "x" * 1500), (2, None, None)], "page_id long, url string, html string")
    got = sorted((x.page_id, x.record_type, x.refers_to) for x in warc.round_trip(pages.repartition(3)).collect() if x.page_id is not None)
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None)]


def test_recall_of_near_duplicates(spark):
    """Classes against the alignment of all pairs, for texts whose id is divisible by 20, at edits of 2 to 20 %."""
    r = random.Random(12)
    voc, texts = vocabulary(r, 4000), []
    for c in range(100):
        base = [r.choice(voc) for _ in range(r.randint(60, 240))]
        texts.append(base)
        for k in range(9):
            t = list(base)
            for at in r.sample(range(len(t)), int(len(t) * r.uniform(0.02, 0.2))):
                t[at] = f"w{r.randrange(10**6)}"
            texts.append(t)
    got = {g.doc_id: g.class_id for g in ordermin.classes(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)).collect()}
    links = found = 0
    for a in range(0, len(texts), 20):
        for b in range(len(texts)):
            n, m = len(texts[a]), len(texts[b])
            if a == b or abs(n - m) > 0.2 * max(n, m) or len(set(texts[a]) & set(texts[b])) < 0.5 * min(n, m):
                continue
            if edit_distance(texts[a], texts[b]) <= 0.2 * max(n, m) + 1e-9:
                links += 1
                found += got[a] == got[b]
            else:
                continue
    assert links > 300 and found >= 0.9 * links
    assert all(got[a] // 10 == a // 10 for a in got)  # no class holds texts of two bases


def test_keys_at_the_threshold():
    """How often one pair alone, at 0.8 with scattered changes, shares a key: no other copies help."""
    r = random.Random(3)
    voc, hits = vocabulary(r, 4000), 0
    for _ in range(150):
        a = [r.choice(voc) for _ in range(200)]
        b = list(a)
        for at in r.sample(range(200), 40):
            b[at] = f"w{at}"
        both = Words([" ".join(x).encode() for x in (a, b)])
        x, y = ordermin.band_keys(*ordermin.labelled_runs(both.hashes(), both.first))
        hits += bool(set(x.tolist()) & set(y.tolist()))
    assert hits >= 0.88 * 150


def test_prefixes_lose_no_pair(spark):
    r = random.Random(6)
    rows, texts = [], []
    for k in range(60):
        a = [r.randrange(80) for _ in range(r.randint(1, 60))]
        b = [x for x in a if r.random() < 0.95] + [r.randrange(80) for _ in range(r.randint(0, 3))]
        texts += [a, b]
    import numpy as np

    facts = spark.createDataFrame([(k, bytearray(np.array(t, np.uint32).tobytes())) for k, t in enumerate(texts)], "rid long, words binary")
    for x in ordermin.prefixes(facts.select("rid"), facts, 0.8).collect():
        rows.append((x.rid, x.part))
    parts = {k: {p for i, p in rows if i == k} for k in range(len(texts))}
    for k in range(0, len(texts), 2):
        if edit_distance(texts[k], texts[k + 1]) <= int(0.2 * max(len(texts[k]), len(texts[k + 1])) + 1e-9):
            assert parts[k] & parts[k + 1]


def test_large_buckets_are_divided(spark, monkeypatch):
    """With blocks of a few texts the classes are the same."""
    r = random.Random(1)
    voc = vocabulary(r, 300)
    passage, texts = [r.choice(voc) for _ in range(50)], []
    for c in range(40):
        base = passage + [r.choice(voc) for _ in range(60)]
        texts += [base, base[:70] + ["other"] * 3 + base[73:]][: 1 + c % 2]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted((g.doc_id, g.class_id) for g in ordermin.classes(docs).collect())
    monkeypatch.setattr(ordermin, "SIDE", 4)
    monkeypatch.setattr(ordermin, "WIDE", 8)
    assert sorted((g.doc_id, g.class_id) for g in ordermin.classes(docs).collect()) == want


def test_overlaps_equal_a_plain_version(spark):
    r = random.Random(2)
    voc = vocabulary(r, 60)
    some = lambda n: [r.choice(voc) for _ in range(n)]
    items = [some(r.choice([3, 5, 6, 7, 8, 9, 12, 30, 70])) for _ in range(25)] + [["twice"] * 12, some(20)]
    items.append(list(items[-1]))
    docs = []
    for k in range(60):
        t, w = some(r.randint(0, 60)), list(r.choice(items))
        for at in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "changed"
        docs.append(t[:20] + w + t[20:] if k % 2 else t)
    want = {}
    for d, t in enumerate(docs):
        for i, b in enumerate(items):
            span = min(len(b), decontam.SPAN)
            if span < decontam.FEWEST:
                continue
            width = min(24, len(b))
            for j in range(len(b) - span + 1):
                begin = max(0, min(j - (width - span) // 2, len(b) - width))
                for at in range(len(t) - span + 1):
                    if any(all(t[at + o] == b[j + o] for o in mask) for mask in decontam.masks(span)):
                        s = begin + at - j
                        share = sum(0 <= s + x < len(t) and t[s + x] == b[begin + x] for x in range(width)) / width
                        if share >= 0.8:
                            want[d, i] = max(want.get((d, i), 0), share)
    got = decontam.overlaps(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"))
    assert {(g.doc_id, g.item_id): g.overlap for g in got.collect()} == pytest.approx(want)


def test_masked_lm_scores_are_those_of_a_plain_forward_pass(spark):
    import numpy as np

    r = random.Random(5)
    voc = vocabulary(r, 6000)
    texts = [" ".join(voc[min(int(r.expovariate(0.002)), 5999)] for _ in range(60)) for _ in range(200)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    counted = masked_lm.word_counts(docs.select("text"))
    model = masked_lm.fit(docs.select("text"), counted)
    n = {x.h & (1 << 64) - 1: x.n for x in counted.collect()}
    got = {g.doc_id: g.pll for g in masked_lm.score(docs).collect()}
    w = model.weights
    for k in range(0, 200, 20):
        words = Words([texts[k].encode()])
        ids, h = model.vocabulary.ids(words), words.hashes()
        total = 0.0
        for i, target in enumerate(ids):
            around = [ids[i + o] if 0 <= i + o < len(ids) else masked_lm.SIZE for o in masked_lm.PLACES]
            x = np.tanh(np.concatenate([w["emb"][a] for a in around]) @ w["mixer"] + w["bias"])
            soft = lambda y: y - y.max() - np.log(np.exp(y - y.max()).sum())
            c, m = divmod(int(target), masked_lm.MEMBERS)
            total += soft(x @ w["cls"] + w["cls_bias"])[c] + soft(x @ w["member"][c] + w["member_bias"][c])[m]
            if target >= masked_lm.KNOWN:
                total += np.log(n[int(h[i])] + masked_lm.SMOOTH) - model.totals[target - masked_lm.KNOWN]
        assert got[k] == pytest.approx(total, rel=1e-3)
    assert got[200] == got[201] == 0


def test_line_labels_are_learned():
    """Texts whose lines are of both kinds: a bad text's clean lines are found good, and kinds follow each other."""
    r = random.Random(8)
    clean = lambda: " ".join(r.choice(["some", "plain", "words", "of", "prose", "here"]) for _ in range(10)) + "."
    junk = lambda: "$$ ## ** %% " * 3
    rows = [("\n".join(clean() for _ in range(8)).encode(), 1, "") for _ in range(60)]
    rows += [("\n".join([junk() for _ in range(6)] + [clean() for _ in range(2)]).encode(), 0, "") for _ in range(60)]
    m = crf.train(rows)
    p, _, first = m.line_marginals([rows[80][0]])
    assert (p[:6] < 0.5).all() and (p[6:] > 0.5).all()
    score, n, good = m.scores([rows[0][0], rows[80][0], b""])
    assert n.tolist() == [8, 8, 1] and good[:2].tolist() == [8, 2] and score[0] > 0.9 > 0.5 > score[1]


def test_thresholds_are_cross_checked():
    r = random.Random(3)
    voc = vocabulary(r, 200)
    rows = [(" ".join(r.choice(voc) for _ in range(20)).encode() + (b" vile" if k % 2 else b""), k % 2, "en" if k % 3 else "de") for k in range(300)]
    m = toxicity.calibrate(toxicity.train(rows), rows)
    assert set(m.thresholds) == {"en", "de"} and all(0 < t < 1 for t in m.thresholds.values())
    scores = m.scores([rows[0][0], rows[1][0]])
    assert scores[0] < 0.5 < scores[1]


def test_places_of_long_texts_and_many_partitions(spark):
    """Repeats are found across many partitions, and in texts of very many words."""
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [(k, f"a{k} {passage} b{k}" if k % 10 == 0 else f"only {k}") for k in range(300)]
    docs.append((300, " ".join(f"u{k}" for k in range(200_000)) + " " + passage))
    made = {x.doc_id: x.n_removed for x in substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(60)).collect()}
    assert all(made[k] == (40 if k % 10 == 0 else 0) for k in made)
    r.shuffle(docs)


def test_hot_keys_are_matched_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 5)
    rows = spark.createDataFrame([(k % 4 if k < 40 else k, k) for k in range(60)], "k int, x int")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("top"))
    want = {k: max(x for y, x in ((j % 4 if j < 40 else j, j) for j in range(60)) if y == (k % 4 if k < 40 else k)) for k in range(60)}
    assert {r.x: r.top for r in common.matched(rows, "k", values).collect()} == want
    assert {r.x: r.top for r in common.matched(rows, "k", values, most=0).collect()} == want


def test_components_of_chains_and_stars(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    for most in (1_000_000, 3):
        monkeypatch.setattr(common, "MANY_EDGES", most)
        got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
