"""The operators as queries over the test tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import caps, codes, language, minhash, mixing, pieces, packing, pii, repair, secrets, token_counts, topk, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return secrets.report(found)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    return pii.report(found)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_and_check(_table(spark, sf_dir, "documents"), path)


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return codes.encoded_documents(_table(spark, sf_dir, "documents"), path, f"codes-{uuid.uuid4().hex}", end_id=1)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))[0]


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(_table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(_table(spark, sf_dir, "documents"), path)


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_token_counts, op3_language_id, op4_secret_ledger, op5_source_mixing,
    op6_top_k, op7_personal_data, op8_sentence_pieces, op9_token_codes, op10_embedding_near_dedup,
    op11_embedding_whitening, op12_conversation_repair, op13_packing,
)}

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_JWT = "eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"


def _spans_sql(kind: str, place: int, pattern: str, valid: str = "true") -> str:
    """The matches of one kind: gaps and matches alternate, so running lengths place them."""
    return f"""
        SELECT doc_id, {place} AS place, '{kind}' AS kind,
               CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i-1]]), 0) AS BIGINT) AS s,
               hits[i] AS hit
        FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS hits,
                           string_split_regex(text, '{pattern}') AS gaps
                    FROM documents)) WHERE {valid.replace('HIT', 'hits[i]')}"""


ORACLES = {
    "op4_secret_ledger": f"""
        WITH found AS (
            {_spans_sql('assign', 0, _ASSIGN, f"length(regexp_extract(HIT, '{_ASSIGN}', 2)) >= 6")}
            UNION ALL {_spans_sql('access', 1, 'AKIA[A-Z0-9]+', 'length(HIT) >= 20')}
            UNION ALL {_spans_sql('hex', 2, '[0-9a-f]+', 'length(HIT) >= 24')}
            UNION ALL {_spans_sql('github', 3, 'gh[pousr]_[A-Za-z0-9]{36,}')}
            UNION ALL {_spans_sql('jwt', 4, _JWT)}
            UNION ALL {_spans_sql('pem', 5, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')}),
        lists AS (
            SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
                   count(*) FILTER (place = 2) AS n_hex,
                   string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' ORDER BY s, place)
                       FILTER (place < 3) AS base,
                   string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' ORDER BY s, place) AS spans
            FROM found GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
               coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN lists USING (doc_id)""",
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
            FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (
            SELECT a AS node, b AS other FROM links
            UNION
            SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
               least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id,
               s.doc_id <= coalesce(min(r.other), s.doc_id) AS kept
        FROM sets s LEFT JOIN reach r ON s.doc_id = r.node GROUP BY s.doc_id, s.s""",
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
               vec_id, score
        FROM scored QUALIFY rank <= 5""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (
            SELECT a AS node, b AS other FROM links
            UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        lowest AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
        SELECT t.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
               least(t.vec_id, coalesce(low, t.vec_id)) AS component_id,
               t.vec_id <= coalesce(low, t.vec_id) AS kept
        FROM embeddings t LEFT JOIN degree ON t.vec_id = a LEFT JOIN lowest ON t.vec_id = node""",
}
