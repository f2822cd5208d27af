"""Bounded, deterministic training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, by: str, most: int) -> tuple[DataFrame, dict]:
    """(rows, counts): at most 2 * most rows of each value of `by`, about `most` on average, chosen by a hash of doc_id.

    Counts by value are taken over all rows; a value with more than `most` rows keeps the share most / count of the hash
    range. Ids that repeat share a hash, so first_rows then bounds the rows; the sample's size is at most 2 * most times the
    number of values, whatever repeats.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    keep: Column = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20))
    for value, n in counts.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (place < int((1 << 20) * min(1.0, most / n)) + (n <= most)))
    return first_rows(rows.where(keep), by, 2 * most), counts


def first_rows(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most `most` rows of each value of `by`, first by a hash of the whole row.

    Spark limits the groups in each task before the shuffle, so a task gets at most `most` rows a value from each of them.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(*rows.columns)))
    names = rows.columns
    return rows.withColumn("_place", rank).where(F.col("_place") <= most).select(*names)
