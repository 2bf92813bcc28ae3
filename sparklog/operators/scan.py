"""Positions and bounded scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("stream", "partition")


def bounds(log: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Oldest and newest offset, first and last timestamp, and count of each partition."""
    return log.groupBy(*by).agg(
        F.min("offset").alias("oldest"),
        F.max("offset").alias("newest"),
        F.min("ts_us").alias("first_ts"),
        F.max("ts_us").alias("last_ts"),
        F.count("*").alias("records"),
    )


def start_at(ts: Column | int) -> Column:
    """Aggregate: the earliest offset at or after ts; past the end the next offset; 0 if empty."""
    ts = F.lit(ts) if isinstance(ts, int) else ts
    return F.coalesce(F.min(F.when(F.col("ts_us") >= ts, F.col("offset"))), F.max("offset") + 1, F.lit(0).cast("long"))


def stop_at(ts: Column | int) -> Column:
    """Aggregate: the latest offset at or before ts; null if the log begins later."""
    ts = F.lit(ts) if isinstance(ts, int) else ts
    return F.max(F.when(F.col("ts_us") <= ts, F.col("offset")))


def _days(ts: str) -> Column:
    return F.floor(F.col(ts) / 86_400_000_000)


def _asked_by_day(log: DataFrame, asked: DataFrame, by: Sequence[str], exact: Column, other_days: Column, whole: Column) -> DataFrame:
    """by, t, _exact and _other for every asked (by, t): aggregates of the records of t's day, and
    of the days on one side of it. Records meet times by equality of day; only the table of days,
    a row for each day of a partition, meets them by order."""
    at = asked.select(*by, "t").distinct()
    same = log.withColumn("_day", _days("ts_us")).join(at.withColumn("_day", _days("t")), [*by, "_day"])
    same = same.groupBy(*by, "t").agg(exact.alias("_exact"))
    days = log.groupBy(*by, _days("ts_us").alias("_day")).agg(whole.alias("_whole"), F.max("offset").alias("_newest"))
    sides = days.join(at, [*by]).groupBy(*by, "t").agg(other_days.alias("_other"), F.max("_newest").alias("_newest"))
    return at.join(sides, [*by, "t"], "left").join(same, [*by, "t"], "left")


def starts_at(log: DataFrame, asked: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """start_at() for every row (by, t) of asked: the earliest offset at or after t."""
    found = _asked_by_day(
        log, asked, by,
        exact=F.min(F.when(F.col("ts_us") >= F.col("t"), F.col("offset"))),
        other_days=F.min(F.when(F.col("_day") > _days("t"), F.col("_whole"))),
        whole=F.min("offset"),
    )
    first = F.coalesce(F.least("_exact", "_other"), F.col("_newest") + 1, F.lit(0).cast("long"))
    return found.select(*by, "t", first.alias("start_offset"))


def stops_at(log: DataFrame, asked: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """stop_at() for every row (by, t) of asked: the latest offset at or before t, null before the log."""
    found = _asked_by_day(
        log, asked, by,
        exact=F.max(F.when(F.col("ts_us") <= F.col("t"), F.col("offset"))),
        other_days=F.max(F.when(F.col("_day") < _days("t"), F.col("_whole"))),
        whole=F.max("offset"),
    )
    return found.select(*by, "t", F.greatest("_exact", "_other").alias("stop_offset"))


def forward(log: DataFrame, start: Column | int, stop: Column | int | None = None, hw: Column | int | None = None) -> DataFrame:
    """Records from start (negative: 0) to stop inclusive, committed ones only if hw is given.

    All three are plain predicates on ``offset``; given as numbers they reach the scan of a stored
    log (see sources.stored).
    """
    out = log.where(F.col("offset") >= F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(0)))
    if stop is not None:
        out = out.where(F.col("offset") <= stop)
    return out if hw is None else out.where(F.col("offset") <= hw)


def reverse(log: DataFrame, start: Column | int, hw: Column | int | None = None, stop: int | None = None) -> DataFrame:
    """Records at or below start (and hw), down to stop; order them by offset, newest first."""
    out = log.where(F.col("offset") <= start)
    out = out if hw is None else out.where(F.col("offset") <= hw)
    return out if stop is None else out.where(F.col("offset") >= stop)


def high_watermarks(log: DataFrame, behind: int) -> DataFrame:
    """A partition state for logs without one: the watermark lies ``behind`` records back."""
    return log.groupBy(*BY).agg((F.max("offset") - behind).alias("hw"))


def with_watermark(log: DataFrame, state: DataFrame) -> DataFrame:
    """Join each partition's watermark; the state has a row for each partition, so Spark may broadcast it."""
    return log.join(state, [*BY])


def idle_gaps(log: DataFrame, limit_us: int, by: Sequence[str] = BY) -> DataFrame:
    """Records that came more than limit_us after the one before them, with idle_us.

    A window holds a day of a partition; the first record of a day is held against the last of
    the day before that had any.
    """
    keyed = log.withColumn("_day", _days("ts_us"))
    inside = Window.partitionBy(*by, "_day").orderBy("offset")
    days = keyed.groupBy(*by, "_day").agg(F.max_by("ts_us", "offset").alias("_last"))
    days = days.select(*by, "_day", F.lag("_last").over(Window.partitionBy(*by).orderBy("_day")).alias("_before"))
    held = keyed.withColumn("_own", F.lag("ts_us").over(inside)).join(days, [*by, "_day"])
    idle = F.col("ts_us") - F.coalesce("_own", "_before")
    return held.withColumn("idle_us", idle).where(F.col("idle_us") > limit_us).drop("_day", "_own", "_before")
