"""The queries of this folder's operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .bpe_tree import encode_decode
from .common import crc_mod, documents
from .language_crf import language
from .licenses import scan
from .licenses import sql as license_sql
from .near_dedup import near_duplicates
from .packing import best_fit
from .pii import find
from .quality_mil import quality
from .quality_rules import sql as quality_sql
from .quality_rules import weak_supervision
from .transcripts import parse

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), WORD_BPE)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_supervision(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir), BYTE_BPE, length=2048, end=0, max_docs=2048)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learned from four fifths of the conversations and recovered for all."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return parse(talks, learn_from=crc_mod("conv_id", 5) != 0)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_minhash_near_dedup, op2_quality_classifier, op3_license_scan, op4_bpe_encode_decode, op5_quality_rules, op6_language_id, op7_best_fit_packing, op8_chat_formatting, op9_nearest_neighbours, op10_personal_data]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op3_license_scan": license_sql(), "op5_quality_rules": quality_sql()}


#: All pairs that share a shingle, whole sets, then the reachable ids.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
  FROM w
), e AS (
  SELECT doc_id, unnest(g) AS h FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * p.n >= 75 * (len(x.g) + len(y.g) - p.n)
), both_ways AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, reached) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT r.id, both_ways.b FROM r JOIN both_ways ON r.reached = both_ways.a
), c AS (
  SELECT id, min(reached) AS least FROM r GROUP BY id
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.least AS component_id, s.doc_id = c.least AS kept
FROM s JOIN c ON c.id = s.doc_id
"""
