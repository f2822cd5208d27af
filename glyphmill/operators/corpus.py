"""Corpus statistics: lines, words, characters, neighbouring symbols, samples."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ..functions import text as T
from ..functions.batches import bucket_blobs, bucket_sums, word_runs
from .ordered import running


def clean_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines normalised, blank ones dropped."""
    return lines.withColumn(text, T.normalize(F.col(text))).where(F.length(text) > 0)


def words(lines: DataFrame, text: str = "text") -> DataFrame:
    """(word) of every word of normalised lines, brackets dropped."""
    return lines.select(F.explode(T.split_words(T.normalize(F.col(text)))).alias("word")).withColumn("word", T.normalize_word(F.col("word"))).where("word <> ''")


def word_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt) of all words; the workers count within runs of lines first."""
    return lines.select(text).mapInArrow(word_runs, "word string, cnt long").groupBy("word").agg(F.sum("cnt").alias("cnt"))


def char_counts(counts: DataFrame) -> DataFrame:
    """Code points weighted by word counts."""
    return counts.select(F.explode(T.code_points(F.col("word"))).alias("ch"), "cnt").groupBy("ch").agg(F.sum("cnt").alias("cnt"))


def pair_counts(counts: DataFrame, least: int = 1) -> DataFrame:
    """Neighbouring code points weighted by word counts, overlapping ones included."""
    pairs = T.let(T.code_points(F.col("word")), lambda s: F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("lhs"), F.element_at(s, i + 1).alias("rhs")))))
    return counts.select(F.explode(pairs).alias("p"), "cnt").groupBy("p.lhs", "p.rhs").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= least)


def best_pair(pairs: DataFrame) -> DataFrame:
    """The commonest pair; ties go to the smaller symbols."""
    return pairs.orderBy(F.desc("cnt"), "lhs", "rhs").limit(1)


def prefix_sample(lines: DataFrame, budget: int, key: str = "line_no", text: str = "text") -> DataFrame:
    """Lines in order while their lengths and line ends fit the budget; empty lines are passed over."""
    full = lines.where(F.length(text) > 0)
    return running(full, key, F.length(text) + 1, "chars").where(F.col("chars") <= budget)


def union_texts(*parts: tuple[DataFrame, Column]) -> DataFrame:
    """(text) of several tables, nulls dropped, duplicates kept."""
    out = None
    for df, column in parts:
        one = df.select(column.alias("text")).where(F.col("text").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def hash_order(df: DataFrame, key: str, share: float = 0.9, of: int = 1000) -> DataFrame:
    """Adds `train`, true for about `share` of the rows, by a fixed multiplicative hash of a number key."""
    return df.withColumn("train", F.pmod(F.col(key).cast("long") * 2654435761, F.lit(of)) < int(of * share))


def hashed_features(rows: DataFrame, key: str, text: str = "text", features: int = 8192, low: int = 1, high: int = 2, chars: bool = False) -> DataFrame:
    """(key, bucket, cnt): bag of hashed word n-grams (no mark between words), optionally of character n-grams of the lower-cased text too."""
    if features <= 0 or low <= 0 or high < low:
        raise ValueError("features and n-gram sizes must be positive and in order")
    lists = [T.alnum_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words")]
    if chars:
        lists.append(F.when(~T.is_blank(F.col(text)), F.lower(text)).alias("chars"))
    kind = StructField("key", rows.schema[key].dataType)
    blobs = StructType([kind, StructField("size", IntegerType()), StructField("blob", BinaryType())])
    each = rows.select(F.col(key).alias("key"), *lists).mapInArrow(partial(bucket_blobs, features=features, low=low, high=high), blobs)
    sums = StructType([kind, StructField("bucket", IntegerType()), StructField("n", LongType())])
    return each.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_sums, sums).toDF(key, "bucket", "cnt")


def dense(features: DataFrame, key: str, size: int) -> DataFrame:
    """(key, vector) from (key, bucket, cnt)."""
    table = features.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("m"))
    return table.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("float")).alias("vector"))
