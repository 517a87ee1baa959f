"""Findings: identity, overlay, order, merge; progress and audit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracehound.functions.binary import uuid5

NAMESPACE = "58f573f1-8a7a-4f77-b598-79db7d4f4ff2"
GENESIS = "genesis"


def fingerprint(path: Column, length: Column, mtime_seconds: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, length.cast("string"), mtime_seconds.cast("string")), 256)


def finding_id(fp: Column, container: Column, offset: Column, signature: Column, mode: str) -> Column:
    return uuid5(NAMESPACE, F.concat_ws("|", fp, F.coalesce(container, F.lit("")), offset.cast("string"), signature, F.lit(mode)))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def overlay(findings: DataFrame, contexts: DataFrame, key: str, bypass: bool = False) -> DataFrame:
    """encrypted and encryption_state of each finding from its source's context."""
    out = findings.join(contexts.select(key, F.lit(True).alias("_e")).distinct(), key, "left")
    state = F.when(F.col("_e"), "bypass_attempted" if bypass else "encrypted_detected").otherwise("unencrypted")
    return out.withColumns({"encrypted": F.coalesce("_e", F.lit(False)), "encryption_state": state}).drop("_e")


def progress(df: DataFrame, order: str, size: str) -> DataFrame:
    """Rows after which the percentage of bytes done has grown: order, processed, percent.

    Running sums go by ranges of 10,000 of order first, so no task sorts the whole table.
    """
    rows = df.select(order, F.col(size).cast("long").alias("size"), F.floor(F.col(order) / 10_000).alias("bucket"))
    sums = rows.groupBy("bucket").agg(F.sum("size").alias("s"))
    sums = sums.select("bucket", F.coalesce(F.sum("s").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    own = F.sum("size").over(W.partitionBy("bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).join(sums, "bucket")
    percent = lambda c: F.least(F.lit(100), F.floor(100 * c / F.greatest("total", F.lit(1)))).cast("long")
    done = F.col("base") + F.col("own")
    rows = rows.select(order, done.alias("processed"), percent(done).alias("percent"), F.when(done == F.col("size"), F.lit(-1)).otherwise(percent(done - F.col("size"))).alias("previous"))
    return rows.where("percent > previous").drop("previous")


def chain_check(log: DataFrame, seq: str, prev: str, entry: str, part: Column) -> DataFrame:
    """Entries whose prev isn't the entry before them. part: ranges of seq that are checked side by side."""
    rows = log.withColumn("_p", part)
    heads = rows.groupBy("_p").agg(F.max_by(entry, seq).alias("_last")).withColumn("_before", F.lag("_last", 1, GENESIS).over(W.orderBy("_p"))).select("_p", "_before")
    rows = rows.withColumn("_lag", F.lag(entry).over(W.partitionBy("_p").orderBy(seq))).join(heads, "_p")
    return rows.withColumn("valid", F.col(prev) == F.coalesce("_lag", "_before")).drop("_p", "_lag", "_before")


def merge_reports(df: DataFrame, group: str, counters: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*(F.sum(c).cast("long").alias(c) for c in counters), F.count("*").alias("reports"))


def eta(processed: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the rate so far; null where nothing is known of the rate."""
    rate = processed / F.nullif(elapsed, F.lit(0))
    left = F.greatest(F.greatest(total, F.lit(1)) - processed, F.lit(0))
    return F.when(rate > 0, F.floor(left / rate + 0.5).cast("long"))
