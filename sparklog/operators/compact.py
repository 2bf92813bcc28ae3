"""Key compaction and retention by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = ("stream", "partition")


def latest_by_key(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The newest record of every key; records without a key are left out.

    max_by aggregates before the shuffle, so a key with most of the records costs one row a task.
    """
    rest = [c for c in log.columns if c not in (*by, "key")]
    newest = log.where(F.col("key").isNotNull()).groupBy(*by, "key").agg(F.max_by(F.struct(*rest), "offset").alias("_r"))
    return newest.select(*by, "key", "_r.*").select(*log.columns)


def compact(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Compact a log with columns segment and hw.

    A record stays if it has no key, is its key's newest committed one, is at or past the high
    watermark, or lies in the last segment. A null key is not an empty key. The newest offsets
    come from a pre-aggregated group by, joined on the key.
    """
    newest = (
        log.where(F.col("key").isNotNull() & (F.col("offset") <= F.col("hw")))
        .groupBy(*by, "key")
        .agg(F.max("offset").alias("_newest"))
    )
    active = log.groupBy(*by).agg(F.max("segment").alias("_active"))
    joined = log.join(newest, [*by, "key"], "left").join(active, [*by])
    keep = (
        F.col("key").isNull()
        | (F.col("offset") == F.col("_newest"))
        | (F.col("offset") >= F.col("hw"))
        | (F.col("segment") == F.col("_active"))
    )
    return joined.where(keep).select(*log.columns)


def segment_stats(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return log.groupBy(*by, "segment").agg(
        F.count("*").alias("records"),
        F.sum("size_bytes").alias("bytes"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.min_by("ts_us", "offset").alias("first_write"),
        F.max_by("ts_us", "offset").alias("last_write"),
    )


def _newest_first(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, 0)


def retain_count(stats: DataFrame, limit: int, measure: str = "records", by: Sequence[str] = BY) -> DataFrame:
    """Segments whose running sum from the newest is within limit; the newest always stays."""
    running = stats.withColumns(
        {"_sum": F.sum(measure).over(_newest_first(by)), "_rank": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("segment")))}
    )
    return running.where((F.col("_sum") <= limit) | (F.col("_rank") == 1)).drop("_sum", "_rank")


def retain_age(stats: DataFrame, cutoff_us: int, by: Sequence[str] = BY) -> DataFrame:
    """Drop the leading run of segments last written before the cutoff; the newest always stays."""
    oldest_first = Window.partitionBy(*by).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("segment")))
    alive = F.max((F.col("last_write") >= cutoff_us).cast("int")).over(oldest_first)
    return stats.withColumns({"_alive": alive, "_rank": newest}).where("_alive = 1 or _rank = 1").drop("_alive", "_rank")


def retain(stats: DataFrame, cutoff_us: int, records: int, size: int) -> DataFrame:
    """Age, then count, then bytes, in this order."""
    return retain_count(retain_count(retain_age(stats, cutoff_us), records), size, "bytes")


def removed(log: DataFrame, kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and how many records compaction removed: a difference of counts, without a join of records."""
    before = log.groupBy(*by).agg(F.count("*").alias("_before"))
    after = kept.groupBy(*by).agg(F.count("*").alias("_after"))
    return before.join(after, [*by], "left").select(*by, (F.col("_before") - F.coalesce("_after", F.lit(0))).alias("removed"))
