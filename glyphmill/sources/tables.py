"""Plain sources and sinks: lines, databases, memoised stages, JSON models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): text lines; numbers rise within and across files in reading order, with gaps."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on a JDBC database; options such as user, password, partitionColumn, fetchsize."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def stage(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet unless path is there already, and reads it."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def export_lines(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def json_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def experience_parquet(log: DataFrame, path: str, most_rows: int = 5_000_000) -> None:
    """The log as Parquet sorted by ticks within files, so that time ranges prune by file statistics."""
    log.repartitionByRange("ticks").sortWithinPartitions("ticks").write.mode("append").option("maxRecordsPerFile", most_rows).parquet(path)
