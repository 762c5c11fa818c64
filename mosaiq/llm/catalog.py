"""The opN queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import byte_bpe, language_id, secrets, token_files
from mosaiq.llm.embedding_dedup import near_vectors
from mosaiq.llm.exact_dedup import exact_dedup
from mosaiq.llm.line_dedup import line_dedup
from mosaiq.llm.mixing import mix
from mosaiq.llm.simhash import near_groups
from mosaiq.llm.substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, dictionary = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(shards, dictionary)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# Lines are marked where the rolling polynomial over two line hashes is 0 modulo 3; chunks end at marked lines as in line_dedup.
SQL3 = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
), l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), c AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS code FROM l
), m AS (SELECT *, (coalesce(lag(code) OVER w, 0) * 1000003 + code) % 2147483647 % 3 = 0 AS marked, count(*) OVER (PARTITION BY doc_id, text) AS n FROM c WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), e AS (SELECT *, marked AND i > 1 AND i < n - 1 AND (i = 2 OR NOT lag(marked) OVER (PARTITION BY doc_id, text ORDER BY i)) AS ends FROM m
), k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e
), p AS (SELECT doc_id, text, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines FROM k GROUP BY doc_id, text, k
), r AS (SELECT *, lines > 1 AND regexp_matches(chunk, '\S') AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, sha256(text), k) > 1 AS gone FROM p
), o AS (
  SELECT doc_id, text, sum(lines)::BIGINT AS n_lines, count(*) AS n_chunks, coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed,
    sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id, text
)
SELECT d.doc_id, n_lines, n_chunks, n_removed, kept_sha256 FROM documents d JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND coalesce(d.text, '') = o.text
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("repeats_history")


SQL5 = """
WITH g AS (SELECT *, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM g
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict_documents(docs, language_id.fit_documents(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).drop("source")


# The SQL fills the sources in order of cap / weight, and lays each source's words in the order of seeded MD5s.
SQL8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, ''))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT
      - coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS remaining, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS w_left
  FROM s WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, remaining::HUGEINT * weight > cap::HUGEINT * w_left AS capped FROM f
), l AS (SELECT max(remaining) FILTER (NOT capped)::DOUBLE / max(w_left) FILTER (NOT capped)::DOUBLE AS level FROM c
), t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE level * weight END AS target FROM c, l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, words - whole * source_size - ahead)))::BIGINT AS taken FROM r
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_token_files, op3_line_dedup, op4_simhash, op5_exact_dedup, op6_byte_bpe, op7_language_id, op8_mixing, op9_secrets, op10_embedding_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": SQL3, "op5_exact_dedup": SQL5, "op8_mixing": SQL8}
