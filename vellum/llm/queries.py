"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import bpe_codec, chat_format, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity, vector_search
from vellum.llm.common import ready, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(ready(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.as_hex(found.fp).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(ready(table(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_search.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return vector_search.search(vectors.where("id % 20 = 0"), vectors)


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_substring_dedup, op3_bpe_codec, op4_simhash, op5_toxicity, op6_quality_rules, op7_token_counts, op8_chat_format, op9_packing, op10_vector_search)}
#: What the template adds, by role: BEGIN once, then these and a backslash for each control string in a text.
ORACLES: dict[str, str] = {
    "op8_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(s>|SYS\]|INST\]|OUT\]|ROLE\]|TURN\])'))
      + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
        ELSE 24 + length(role) + len(regexp_extract_all(role, '[<\[]\\*/?(s>|SYS\]|INST\]|OUT\]|ROLE\]|TURN\])')) END) AS n
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (3 + n)::BIGINT AS formatted_chars FROM g
""",
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op10_vector_search": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
""",
}
