"""Failure detection: reports that come close together, and what a quorum of them sets off."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Failover:
    """More than quorum(members) distinct witnesses, each within timeout_us of the report before."""

    quorum: Callable[[Column], Column]
    timeout_us: int


def leader_failover(timeout_us: int) -> Failover:
    """For partitions: of the other in-sync replicas more than half."""
    return Failover(lambda isr: F.floor((isr - 1) / 2), timeout_us)


def coordinator_failover(timeout_us: int) -> Failover:
    """For groups: more than half of the members."""
    return Failover(lambda members: F.floor(members / 2), timeout_us)


def rounds(reports: DataFrame, by: Sequence[str], strategy: Failover, order: str = "ts_us") -> DataFrame:
    """by, round, first_us, last_us and witnesses of each run of reports (by, ts_us, witness).

    Runs are split inside each day first and the days' edges are carried over, so that a window
    holds a day of one key, not all of it.
    """
    day = F.floor(F.col(order) / 86_400_000_000)
    inside = Window.partitionBy(*by, "_day").orderBy(order, "witness")
    split = reports.withColumn("_day", day).withColumn("_gap", F.col(order) - F.lag(order).over(inside))
    days = split.groupBy(*by, "_day").agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    across = Window.partitionBy(*by).orderBy("_day")
    days = days.select(*by, "_day", (F.col("_first") - F.lag("_last").over(across)).alias("_carried"))
    split = split.join(days, [*by, "_day"])
    gap = F.coalesce("_gap", "_carried")
    split = split.withColumn("_new", F.when(gap.isNull() | (gap > strategy.timeout_us), 1).otherwise(0))
    # the number of a run is the count of starts before, in the day and in the days before
    starts = split.groupBy(*by, "_day").agg(F.sum("_new").alias("_n"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*by, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = split.join(starts, [*by, "_day"]).withColumn("round", (F.col("_base") + F.sum("_new").over(inside)).cast("long"))
    return numbered.groupBy(*by, "round").agg(F.min(order).alias("first_us"), F.max(order).alias("last_us"), F.count_distinct("witness").alias("witnesses"))


def elect(found: DataFrame, members: DataFrame, by: Sequence[str], strategy: Failover) -> DataFrame:
    """The rounds with more witnesses than the quorum of their members (by, members)."""
    return found.join(members, [*by]).where(F.col("witnesses") > strategy.quorum(F.col("members")))


def out_of_sync(replicas: DataFrame, now_us: int, lag_us: int) -> DataFrame:
    """Replicas (seen_us, caught_up_us) that have not been seen, or not caught up, for too long."""
    late = lambda c: F.lit(now_us) - F.col(c) > lag_us
    return replicas.where(late("seen_us") | late("caught_up_us"))
