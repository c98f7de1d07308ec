"""The queries of this subpackage, one an operator, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import codes, langid, linededup, media, neighbours, packing, pieces, secrets, sharding, simhash, substrings, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.conversation_groups(table(spark, sf_dir, "conversations"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_templates(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, words=secrets.ranked_words(docs)).drop("redacted")


def op11_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digests(table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_rows(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    own = (op1_best_fit_packing, op2_warc, op3_simhash, op4_chroma_fingerprints, op5_sentencepiece, op6_substring_dedup, op7_line_dedup, op8_nearest_neighbours, op9_language_id, op10_secret_scan, op11_hilbert_sharding, op12_vector_codes, op13_embedding_whitening)
    return {f.__name__: f for f in own}


OP2_SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
     hashed AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS last FROM own),
     cut AS (SELECT *, [('0x' || substr(h, 5 * k + 1, 5))::BIGINT FOR k IN range(0, 8)] AS parts FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((p >> s) & 31)::INT + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR p IN parts], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM cut
"""

OP6_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
                 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
     ranked AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at FROM ranked WHERE least < doc_id),
     places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS at, unnest(w) AS word FROM words),
     kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.at) AS kept, count(*) AS n FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op7_line_dedup": linededup.SQL, "op11_hilbert_sharding": sharding.SQL, "op12_vector_codes": codes.SQL}
