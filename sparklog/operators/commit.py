"""Commit tracking, cursors, placement and group assignment."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.errors import InvalidArgument
from sparklog.operators.sequence import sequence

BY = ("stream", "partition")


def high_watermark(replicas: DataFrame, min_isr: int, by: Sequence[str] = BY, old: DataFrame | None = None) -> DataFrame:
    """isr and hw: the least latest offset of the in-sync replicas, never below the old watermark.

    A partition with fewer than min_isr replicas commits nothing: it keeps the old watermark, from
    ``old`` (by, hw), which is -1 where there is none.
    """
    out = replicas.groupBy(*by).agg(F.min("latest").alias("_least"), F.count("*").alias("isr"))
    known = out.withColumn("_old", F.lit(-1).cast("long"))
    if old is not None:
        known = out.join(old.select(*by, F.col("hw").alias("_old")), [*by], "left").withColumn("_old", F.coalesce("_old", F.lit(-1).cast("long")))
    moved = F.greatest(F.col("_old"), F.col("_least"))
    return known.select(*by, "isr", F.when(F.col("isr") >= min_isr, moved).otherwise(F.col("_old")).cast("long").alias("hw"))


def ack_time(policy: Column, written: Column, committed: Column) -> Column:
    """When a record is acknowledged: at write, at commit, or never."""
    return F.when(policy == "LEADER", written).when(policy == "ALL", committed)


def latest_cursors(cursors: DataFrame, key: Sequence[str]) -> DataFrame:
    return cursors.groupBy(*key).agg(F.max_by("cursor_offset", "log_offset").alias("cursor_offset"))


def set_cursors(writes: DataFrame, order: str) -> DataFrame:
    """The cursor store after writes (stream, partition, cursor_id, cursor_offset): the newest of
    each key. A write without a stream or an id is refused and changes nothing."""
    good = writes.where("coalesce(stream, '') != '' and coalesce(cursor_id, '') != ''")
    return latest_cursors(good.withColumnRenamed(order, "log_offset"), ["stream", "partition", "cursor_id"])


def fetch_cursors(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (stream, partition, cursor_id) with cursor_offset, -1 where none is stored, and error."""
    key = ["stream", "partition", "cursor_id"]
    error = F.when(F.coalesce("stream", F.lit("")) == "", "NO_STREAM").when(F.coalesce("cursor_id", F.lit("")) == "", "NO_CURSOR_ID")
    found = asked.join(stored, key, "left").withColumn("error", error)
    offset = F.when(F.col("error").isNull(), F.coalesce("cursor_offset", F.lit(-1).cast("long")))
    return found.withColumn("cursor_offset", offset)


def lag(log_bounds: DataFrame, cursors: DataFrame, key: Sequence[str]) -> DataFrame:
    """Records after each cursor; a partition without one counts from the beginning."""
    joined = log_bounds.join(cursors, [*key], "left")
    return joined.withColumn("cursor_offset", F.coalesce("cursor_offset", F.lit(-1).cast("long"))).withColumn(
        "lag", F.col("newest") - F.col("cursor_offset")
    )


def choose_replicas(brokers: DataFrame, factor: int, by: Sequence[str] = (), cluster: int | None = None) -> DataFrame:
    """The ``factor`` brokers with the least load, ties in input order; -1 takes all.

    A factor of 0, below -1, or above the number of brokers (``cluster``, else counted) is refused.
    """
    if factor != -1:
        if factor <= 0:
            raise InvalidArgument(f"replication factor {factor} is not positive")
        if cluster is None:
            cluster = brokers.groupBy(*by).count().agg(F.min("count")).first()[0] or 0
        if factor > cluster:
            raise InvalidArgument(f"replication factor {factor} exceeds the cluster's size {cluster}")
    rank = Window.partitionBy(*by).orderBy("load", "position") if by else Window.partitionBy(F.lit(0)).orderBy("load", "position")
    ranked = brokers.withColumn("rank", F.row_number().over(rank).cast("long"))
    return ranked if factor < 0 else ranked.where(F.col("rank") <= factor)


def assign_partitions(members: DataFrame, streams: DataFrame) -> DataFrame:
    """The member that holds each partition, for members (stream, member) of one stream each.

    Partition p goes to the member of rank p % n by id, as Group deals them. Members are ranked
    by sequence(), so that a stream with many of them is spread over tasks.
    """
    own = members.select("stream", "member").distinct()
    ranked = sequence(own, ["stream"], ["member"], bucket=F.substring("member", 1, 4)).withColumnRenamed("offset", "rank")
    sizes = own.groupBy("stream").agg(F.count("*").alias("n"))
    held = streams.where("partitions > 0").join(sizes, "stream")
    held = held.select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("partitions").cast("long") - 1)).alias("partition"), "n")
    return held.withColumn("rank", F.col("partition") % F.col("n")).join(ranked, ["stream", "rank"]).select("stream", "partition", "member")


class Group:
    """A consumer group's assignment, a fold over membership events.

    Each stream keeps its subscribers in a heap by (partitions held over all streams, id). A
    change rebalances a stream: its partitions are given out again, each to the heap's least.
    State is a group's members and partitions, never records.
    """

    def __init__(self, partitions: dict[str, int]) -> None:
        self.partitions = dict(partitions)
        self.members: dict[str, set[str]] = {}
        self.assigned: dict[str, dict[str, list[int]]] = {}

    def join(self, member: str, streams: Iterable[str]) -> None:
        if member in self.members:
            raise ValueError(f"{member} is a member already")
        if unknown := set(streams) - set(self.partitions):
            raise ValueError(f"unknown streams: {sorted(unknown)}")
        self.members[member] = set()
        self.assigned[member] = {}
        for s in sorted(streams):
            self.members[member].add(s)
            self._rebalance(s)

    def leave(self, member: str) -> None:
        held = self.assigned.pop(member)
        for s in sorted(self.members.pop(member)):
            if held.get(s):
                self._rebalance(s)

    def delete_stream(self, stream: str) -> None:
        del self.partitions[stream]
        touched = set()
        for m, streams in self.members.items():
            if stream in streams:
                streams.discard(stream)
                self.assigned[m].pop(stream, None)
                touched |= streams
        for s in sorted(touched):
            self._rebalance(s)

    def _rebalance(self, stream: str) -> None:
        own = [m for m, streams in self.members.items() if stream in streams]
        for m in own:
            self.assigned[m][stream] = []
        heap = [(sum(map(len, self.assigned[m].values())), m) for m in own]
        heapq.heapify(heap)
        for p in range(self.partitions[stream] if heap else 0):
            n, m = heap[0]
            self.assigned[m][stream].append(p)
            heapq.heapreplace(heap, (n + 1, m))


def fold_groups(events: DataFrame, partitions: dict[str, int]) -> DataFrame:
    """The assignments (group, stream, partition, member) after all membership events.

    ``events`` has group, seq, member, op (join or leave) and streams; a join of a member and a
    leave of one that is none change nothing. A group's events are folded by one task.
    """

    def fold(pdf):
        group = Group(partitions)
        for e in pdf.sort_values("seq").itertuples():
            if e.op == "join" and e.member not in group.members:
                group.join(e.member, list(e.streams))
            elif e.op == "leave" and e.member in group.members:
                group.leave(e.member)
        rows = [(pdf["group"].iloc[0], s, p, m) for m, held in group.assigned.items() for s, ps in held.items() for p in ps]
        return pd.DataFrame(rows, columns=["group", "stream", "partition", "member"])

    schema = f"group {dict(events.dtypes)['group']}, stream string, partition long, member string"
    return events.groupBy("group").applyInPandas(fold, schema)
