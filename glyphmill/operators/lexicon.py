"""Sense inventories and word-sense examples from lexicon tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def text_export(synsets: DataFrame, samples: DataFrame) -> DataFrame:
    """Definitions and samples that are not null, one column, duplicates kept."""
    return synsets.select(F.col("definition").alias("text")).unionByName(samples.select(F.col("sample").alias("text"))).where("text is not null")


def sample_rows(samples: DataFrame, synsets: DataFrame, words: DataFrame, most: int = 200_000) -> DataFrame:
    """Samples with their synset's part of speech and, if there is one, their word; the first `most` by sampleid."""
    joined = samples.where("sample is not null").join(synsets.select("synsetid", "posid"), "synsetid").join(words.select("wordid", "word"), "wordid", "left")
    return joined.select("sampleid", "sample", "synsetid", "posid", "word").orderBy("sampleid").limit(most)


def senses(words: DataFrame, senses: DataFrame, synsets: DataFrame, most: int = 64) -> DataFrame:
    """(lemma, pos, synset_id, gloss, sense_num, place): the first `most` senses of every lemma and part of speech."""
    joined = senses.join(synsets, "synsetid").join(words, "wordid")
    rows = joined.select(F.col("word").alias("lemma"), F.col("posid").alias("pos"), F.col("synsetid").cast("string").alias("synset_id"), F.col("definition").alias("gloss"), F.coalesce("sensenum", F.lit(0)).alias("sense_num"))
    return top_per_key(rows, ["lemma", "pos"], ["sense_num", "synset_id"], most)


def top_per_key(rows: DataFrame, keys: list[str], order: list[str], most: int, name: str = "place") -> DataFrame:
    """The first `most` rows of each key, numbered from 1 in `name`. Spark limits each group before the shuffle."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


def candidates(senses: DataFrame) -> DataFrame:
    """(lemma, pos, cands): each key's senses in order, as one array."""
    return senses.groupBy("lemma", "pos").agg(F.array_sort(F.collect_list(F.struct("place", "synset_id", "gloss"))).alias("cands"))  # at most the kept senses a key


def lookup(keys: DataFrame, inventory: DataFrame) -> DataFrame:
    """Keys with their candidates, an empty array where there are none."""
    none = F.array().cast(inventory.schema["cands"].dataType)
    return keys.join(inventory, ["lemma", "pos"], "left").withColumn("cands", F.coalesce("cands", none))


def distinct_keys(examples: DataFrame) -> DataFrame:
    return examples.select("lemma", "pos").distinct()


def target_index(tokens, lemma):
    """First place, from 0, of a token that is the lemma in lower case without punctuation at its end; -1 if none."""
    return (F.array_position(F.transform(tokens, lambda t: F.lower(T.trim_punctuation(t))), lemma) - 1).cast("int")


def examples(rows: DataFrame, cap: int = 2000) -> DataFrame:
    """Word-sense examples from sample rows: located targets, at most `cap` a lemma and part of speech, in sampleid order."""
    made = rows.where(~T.is_blank(F.col("sample")) & ~T.is_blank(F.col("word"))).withColumn("tokens", T.split_words(F.col("sample")))
    made = made.select(F.col("sampleid").alias("ex_id"), "tokens", target_index(F.col("tokens"), F.col("word")).alias("target_index"), F.col("word").alias("lemma"), F.col("posid").alias("pos"), F.col("synsetid").cast("string").alias("gold"))
    return top_per_key(made.where("target_index >= 0"), ["lemma", "pos"], ["ex_id"], cap).drop("place")


def with_gold(examples: DataFrame, inventory: DataFrame, most: int = 16) -> DataFrame:
    """Examples with their first `most` candidates and gold_index (the last candidate with the gold id); others are dropped."""
    met = examples.join(inventory, ["lemma", "pos"]).withColumn("cands", F.slice("cands", 1, most))
    ids = F.reverse(F.transform("cands", lambda c: c["synset_id"]))
    place = F.array_position(ids, F.col("gold"))
    return met.withColumn("gold_index", F.when(place > 0, F.size("cands") - place).otherwise(-1).cast("int")).where("gold_index >= 0")


def read_examples(lines: DataFrame) -> DataFrame:
    """Word-sense examples from lines of five tab-separated columns (sentence, target, lemma, part of speech, gold); blank lines, # lines and bad targets are skipped."""
    parts = lines.where(~T.is_blank(F.col("value")) & ~F.col("value").startswith("#")).withColumn("p", F.split("value", "\t")).where("size(p) >= 5")
    out = parts.select(T.split_words(F.get("p", F.lit(0))).alias("tokens"), F.expr("try_cast(get(p, 1) as int)").alias("target_index"), F.trim(F.get("p", F.lit(2))).alias("lemma"), F.trim(F.get("p", F.lit(3))).alias("pos"), F.trim(F.get("p", F.lit(4))).alias("gold"))
    return out.where("target_index is not null and target_index >= 0 and target_index < size(tokens)")


def read_senses(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """(lemma, pos, cands) from numbered lines of four or five tab-separated columns (lemma, part of speech, synset, gloss, examples by |)."""
    parts = lines.where(~T.is_blank(F.col("value")) & ~F.col("value").startswith("#")).withColumn("p", F.split("value", "\t")).where("size(p) >= 4")
    more = F.when(F.size("p") > 4, T.split_list(F.get("p", F.lit(4)))).otherwise(F.array().cast("array<string>"))
    rows = parts.select(order, F.trim(F.get("p", F.lit(0))).alias("lemma"), F.trim(F.get("p", F.lit(1))).alias("pos"), F.trim(F.get("p", F.lit(2))).alias("synset_id"), F.trim(F.get("p", F.lit(3))).alias("gloss"), more.alias("examples"))
    return rows.groupBy("lemma", "pos").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), "synset_id", "gloss", "examples"))).alias("cands"))
