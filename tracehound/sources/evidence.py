"""Evidence: rows (source_path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, *roots: str) -> DataFrame:
    """Regular files below the roots: source_path, length, mtime, content (read only where asked for)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return df.select(F.regexp_replace("path", "^file:/*", "/").alias("source_path"), "length", F.col("modificationTime").alias("mtime"), "content").dropDuplicates(["source_path"])


def from_text(df: DataFrame, prefix: str, key: str, text: str) -> DataFrame:
    return df.select(F.concat(F.lit(prefix + "/"), F.col(key)).alias("source_path"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("content"))


def chunk_ranges(df: DataFrame, length: str, chunk: int, overlap: int) -> DataFrame:
    """A row for each chunk: chunk_start, chunk_end (with overlap, within the length). Empty sources have none."""
    n = F.col(length)
    last = F.ceil(n / chunk) - 1
    rows = df.where(n > 0).withColumn("chunk_start", F.explode(F.sequence(F.lit(0).cast("long"), (last * chunk).cast("long"), F.lit(chunk).cast("long"))))
    return rows.withColumn("chunk_end", F.least(F.col("chunk_start") + chunk + overlap, n.cast("long")))
