"""A training corpus from raw documents in five stages, each a table in and a table out.

Language ID drops documents without a recognisable language, quality rules drop junk, near-dedup keeps one document of each
group, personal data is replaced by its kind, and what is left is packed into sequences of at most 2048 tokens.

Defined results for every stage: whole texts are read, however long; rows that repeat a doc_id or a whole row answer each for
themselves, but near_dedup keeps one row of each; a null doc_id stays out of groups and is kept; further columns are carried
through whatever their names, up to packing; an empty table gives an empty one. A null, empty or letterless text has no language
and goes in the first stage; in a later stage it would fail the rules, stand alone, stay as it is, or be a piece of one end mark.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import documents, few, save
from glyphmill.llm.language_crf import select_language
from glyphmill.llm.near_dedup import near_duplicates
from glyphmill.llm.packing import best_fit
from glyphmill.llm.pii import redact
from glyphmill.llm.quality_rules import select_quality


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language has a mean posterior of 0.4 or more."""
    return select_language(docs, least=0.4)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return select_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; repeated rows count as copies."""
    dropped = save(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    left = docs.join(few(dropped, dropped.count()), "doc_id", "left_anti").select(*docs.columns)
    repeated = save(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    n = repeated.count()
    once = left.join(few(repeated, n), "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(few(repeated, n), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end=0, max_docs=2048)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Neither a conditional random field nor the packing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
