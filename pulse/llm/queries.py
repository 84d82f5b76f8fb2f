"""Queries opN_<name> of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_search, chat_preference, ctw, exact_dedup, mbs_packing, quality, recompression, resync_counts, secret_forest, sentencepiece_viterbi, simhash_bk, variant_groups, voronoi_knn
from .common import read

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn
    return add


@query("op9_exact_dedup", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT DISTINCT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_groups(read(spark, sf_dir, "documents"), shingle=3, radius=2, seed=42)


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mbs_packing.pack_documents(read(spark, sf_dir, "documents"), BPE, capacity=1024, end_id=2)


@query("op7_exact_top_k", """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
      FROM e q JOIN e d ON q.row <> d.row WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20, scale=64)


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.ctw_scores(read(spark, sf_dir, "documents"), ctw.one_in_seven, depth=5)


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.repeats(read(spark, sf_dir, "documents"), window=50).drop("spans")


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.digests(read(spark, sf_dir, "documents"), PIECES)


@query("op3_chat_preference", """
WITH t AS (SELECT DISTINCT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
reply AS (SELECT pair_id, turn AS last_turn, text AS reply FROM
          (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC NULLS LAST, text DESC) AS k FROM t WHERE role = 'assistant') WHERE k = 1),
chosen AS (SELECT t.* FROM t JOIN reply r USING (pair_id) WHERE coalesce(t.turn <= r.last_turn, t.turn IS NULL)),
rejected AS (SELECT t.* FROM t JOIN reply r USING (pair_id)
             WHERE t.turn < r.last_turn OR (t.turn IS NULL AND (r.last_turn IS NOT NULL OR t.role <> 'assistant' OR t.text <> r.reply))
             UNION SELECT r.pair_id, r.last_turn, 'assistant', n.reply FROM reply r JOIN reply n ON n.pair_id = xor(r.pair_id, 1)),
a AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM chosen),
b AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rejected),
pairs AS (SELECT pair_id FROM a INTERSECT SELECT pair_id FROM b),
pos AS (SELECT pair_id, pos FROM a UNION SELECT pair_id, pos FROM b),
cut AS (SELECT p.pair_id, coalesce(min(CASE WHEN a.role = b.role AND a.text = b.text THEN NULL ELSE p.pos END), max(p.pos) + 1) - 1 AS common
        FROM pos p LEFT JOIN a ON a.pair_id = p.pair_id AND a.pos = p.pos LEFT JOIN b ON b.pair_id = p.pair_id AND b.pos = p.pos GROUP BY p.pair_id),
sides AS (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b),
lines AS (SELECT s.side, s.pair_id, s.pos, s.pos <= c.common AS shared, s.role, '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) AS line,
                 length(s.role) + 5 AS head FROM sides s JOIN cut c USING (pair_id)),
placed AS (SELECT *, sum(length(line)) OVER (PARTITION BY side, pair_id, shared ORDER BY pos) - length(line) AS begins FROM lines),
done AS (SELECT side, pair_id, coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE shared), '') AS prompt,
                coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE NOT shared), '') AS rest,
                coalesce(string_agg((begins + head) || ':' || (begins + length(line)), ';' ORDER BY pos) FILTER (WHERE NOT shared AND role = 'assistant'), '') AS mask
         FROM placed GROUP BY side, pair_id)
SELECT x.pair_id, CAST(c.common AS BIGINT) AS common_turns, x.prompt, x.rest AS chosen, y.rest AS rejected, x.mask AS chosen_mask, y.mask AS rejected_mask
FROM pairs JOIN done x ON x.pair_id = pairs.pair_id AND x.side = 'a' JOIN done y ON y.pair_id = pairs.pair_id AND y.side = 'b' JOIN cut c ON c.pair_id = pairs.pair_id""")
def op3_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat_preference.reply_pairs(chat_preference.turns(read(spark, sf_dir, "conversations")))
    rows = chat_preference.preference_rows(chosen, rejected)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.cast("array<string>"))), ";")
    return rows.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without the secrets themselves."""
    found = secret_forest.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("word_index").cast("long").alias("word_index"), "length", "label", "score", "is_secret",
                        F.sha2("candidate", 256).alias("candidate_sha256"))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resync_counts.token_counts(read(spark, sf_dir, "documents"), WORDS, limit=2048)


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups.spelling_variants(read(spark, sf_dir, "documents"), shortest=6, least=5, rate=199, ratio=5)


@query("op13_lexical_search", r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * s.docs + 2) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * s.docs) // s.len) AS m FROM d, s),
i AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT row_number() OVER () AS item, item_id, coalesce(text, '') AS text FROM benchmark))),
score AS (SELECT i.item, i.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
          FROM i JOIN tf ON tf.term = i.term JOIN w ON w.term = i.term JOIN m ON m.r = tf.r GROUP BY i.item, i.item_id, m.r, m.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
           FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)
