"""Global ranks and running sums without sorting a table into one task.

Rows are grouped into blocks of `width` key values, blocks into blocks of blocks while their numbers span more than `most`;
each level sums within its blocks. Only the window over the top level runs in one task, with at most `most` rows, also where
keys are sparse (hashes, 64-bit ids) or lie in clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 1_000_000


def _before(blocks: DataFrame, span: float, width: int, most: int) -> DataFrame:
    """(_block, _before): the sum of _total over all blocks of a smaller number; span: how far the numbers reach."""
    if span <= most:
        return blocks.select("_block", (F.sum("_total").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")).alias("_before"))
    placed = blocks.withColumn("_up", F.floor(F.col("_block") / width))
    above = _before(placed.groupBy(F.col("_up").alias("_block")).agg(F.sum("_total").alias("_total")), span / width, width, most)
    within = F.sum("_total").over(W.partitionBy("_up").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")
    return placed.withColumn("_within", within).join(above.toDF("_up", "_above"), "_up").select("_block", (F.col("_above") + F.col("_within")).alias("_before"))


def running(df: DataFrame, key: str, value: Column, name: str, width: int = 10_000, most: int = MOST) -> DataFrame:
    """Adds `name`, the sum of value over all rows with a key up to this row's (keys are unique numbers)."""
    ends = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    span = 0 if ends.a is None else (float(ends.b) - float(ends.a)) / width
    rows = df.withColumn("_block", F.floor(F.col(key) / width)).withColumn("_value", value)
    before = _before(rows.groupBy("_block").agg(F.sum("_value").alias("_total")), span, width, most)
    within = F.sum("_value").over(W.partitionBy("_block").orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(before, "_block").withColumn(name, F.col("_before") + within).drop("_block", "_value", "_before")


def ranked(df: DataFrame, key: str, name: str = "rank", width: int = 10_000, most: int = MOST) -> DataFrame:
    """Adds `name`, the row's place from 0 in the order of a unique number key."""
    return running(df, key, F.lit(1), name, width, most).withColumn(name, F.col(name) - 1)
