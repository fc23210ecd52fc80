"""The numbered training-data queries, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revloom.llm.chat_format import chat_format
from revloom.llm.common import read_table
from revloom.llm.exact_dedup import exact_dedup
from revloom.llm.language_id import language_report
from revloom.llm.mixing import mixture_report
from revloom.llm.near_dedup import near_dedup_report
from revloom.llm.packing import packed_documents
from revloom.llm.prefix_trie import prefix_trie
from revloom.llm.quality import quality_report
from revloom.llm.secret_scan import secret_report
from revloom.llm.sharding import sharding_report
from revloom.llm.structure_repair import repair_report
from revloom.llm.substring_dedup import substring_report
from revloom.llm.token_counts import token_counts


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(read_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup_report(read_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding_report(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(read_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(read_table(spark, sf_dir, "conversations"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read_table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_sharding, op4_secret_scan, op5_exact_dedup, op6_language_id, op7_chat_formatting, op8_best_fit_packing, op9_mixing, op10_quality_rules, op11_token_counts, op12_structure_repair, op13_prefix_trie)}


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""


OP7_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position FROM t),
p AS (SELECT conv_id, position, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY position) AS prefix,
  count(*) OVER (PARTITION BY conv_id) AS n_turns FROM n),
w AS (SELECT min(conv_id) AS conv_id, n_turns, prefix FROM p WHERE position = n_turns - 1 GROUP BY n_turns, prefix),
k AS (SELECT conv_id, n_turns FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position < p.n_turns - 1 AND p.position = w.n_turns - 1 AND p.prefix = w.prefix))
SELECT n.conv_id, position // 256 AS part, n_turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY position) AS rendered
FROM n JOIN k USING (conv_id) GROUP BY n.conv_id, part, n_turns
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_chat_formatting": OP7_SQL}
