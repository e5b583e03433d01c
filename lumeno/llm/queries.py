"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumeno.llm import crf, crosstok, decontam, masked_lm, merkle, ordermin, packing, parity, rules, secrets, substring, toxicity, warc
from lumeno.llm.common import table


def op1_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("redacted")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.classes(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.join(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity_cnn, op2_warc_round_trip, op3_masked_lm, op4_repeated_passages, op5_best_fit_packing, op6_secret_scan, op7_order_minhash, op8_benchmark_decontamination, op9_quality_crf, op10_quality_rules, op11_merkle_manifest, op12_cross_tokenizer_alignment, op13_parity_join)}
ORACLES: dict[str, str] = {
    "op2_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS b FROM pages),
        q AS (SELECT page_id, octet_length(b) AS n, sha1(html) AS d FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM q)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM r""",
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                   text,
                   CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                       lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed
            FROM documents),
        leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
            FROM d),
        nodes(source, level, idx, h, n) AS (
            SELECT source, 0, idx, leaf, n FROM leaves
            UNION ALL
            SELECT source, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3),
        roots AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
        tops(level, idx, h, n) AS (
            SELECT 0, idx, subroot, n FROM roots
            UNION ALL
            SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3),
        sides AS (
            SELECT l.doc_id, nodes.level AS step_no, l.idx // (3 ** nodes.level)::BIGINT AS own, nodes.idx AS idx, nodes.h AS h
            FROM leaves l JOIN nodes ON l.source IS NOT DISTINCT FROM nodes.source AND nodes.n > 1 AND nodes.idx // 3 = l.idx // (3 ** (nodes.level + 1))::BIGINT
            UNION ALL
            SELECT l.doc_id, 1000 + tops.level, roots.idx // (3 ** tops.level)::BIGINT, tops.idx, tops.h
            FROM leaves l JOIN roots ON l.source IS NOT DISTINCT FROM roots.source JOIN tops ON tops.n > 1 AND tops.idx // 3 = roots.idx // (3 ** (tops.level + 1))::BIGINT),
        steps AS (
            SELECT doc_id, step_no, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < own), '') || '|' || coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > own), '') AS step
            FROM sides GROUP BY doc_id, step_no),
        proofs AS (SELECT doc_id, list(step ORDER BY step_no) AS steps FROM steps GROUP BY doc_id),
        checked AS (
            SELECT l.doc_id, l.leaf, roots.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(p.steps, []), ''), '|', '')) AS proof_sha256,
                   list_reduce(list_prepend(l.tampered, coalesce(p.steps, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
            FROM leaves l JOIN roots ON l.source IS NOT DISTINCT FROM roots.source LEFT JOIN proofs p ON p.doc_id = l.doc_id)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM checked""",
    "op13_parity_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        digests AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS d FROM s GROUP BY doc_id),
        heads AS (SELECT d, min(doc_id) AS head FROM digests GROUP BY d),
        t AS (SELECT s.* FROM s JOIN heads ON s.doc_id = heads.head),
        linked AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
        reached(a, b) AS (SELECT head, head FROM heads UNION SELECT reached.a, linked.b FROM reached JOIN linked ON reached.b = linked.a),
        least AS (SELECT a, min(b) AS c FROM reached GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.c, w.doc_id) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN digests ON digests.doc_id = w.doc_id LEFT JOIN heads ON heads.d = digests.d LEFT JOIN least ON least.a = heads.head""",
}
