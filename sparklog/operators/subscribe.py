"""Subscriptions: positions resolved and checked for many requests at a time, then the records.

A request has spec_id, stream, partition, start_position with start_offset or start_us,
stop_position with stop_offset or stop_us, and reverse. Positions are OFFSET, TIMESTAMP,
EARLIEST, LATEST and NEW_ONLY to start, ON_CANCEL, OFFSET, TIMESTAMP and LATEST to stop.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog import errors
from sparklog.operators import scan

BY = ["stream", "partition"]
SPEC = "spec_id long, stream string, partition int, start_position string, start_offset long, start_us long, stop_position string, stop_offset long, stop_us long, reverse boolean"
#: The error of a request, and the exception for it.
ERRORS = {
    "NO_SUCH_PARTITION": errors.NotFound,
    "UNKNOWN_START": errors.InvalidArgument,
    "UNKNOWN_STOP": errors.InvalidArgument,
    "STOP_BEFORE_LOG": errors.InvalidArgument,
    "EMPTY": errors.ResourceExhausted,
    "STOP_BEFORE_START": errors.InvalidArgument,
}


@dataclass(frozen=True)
class Spec:
    stream: str
    partition: int
    start_position: str = "NEW_ONLY"
    start_offset: int | None = None
    start_us: int | None = None
    stop_position: str = "ON_CANCEL"
    stop_offset: int | None = None
    stop_us: int | None = None
    reverse: bool = False
    spec_id: int = 0


def since(now_us: int, delta_us: int) -> dict[str, object]:
    """A start some time ago, for Spec."""
    return {"start_position": "TIMESTAMP", "start_us": now_us - delta_us}


def resolve(specs: DataFrame, log: DataFrame, partitions: DataFrame) -> DataFrame:
    """specs with start, stop (null: unbounded) and error (null: none).

    ``partitions`` lists (stream, partition) that exist, empty ones too. A stop is a lower bound
    for reverse requests, and may not lie above their start.
    """
    known = partitions.select(*BY, F.lit(True).alias("_exists")).distinct()
    bounds = log.groupBy(*BY).agg(F.min("offset").alias("_oldest"), F.max("offset").alias("_newest"))
    asked = specs.join(known, BY, "left").join(bounds, BY, "left")
    times = lambda c: specs.where(F.col(c).isNotNull()).select(*BY, F.col(c).alias("t"))
    starts = scan.starts_at(log, times("start_us")).withColumnRenamed("t", "start_us").withColumnRenamed("start_offset", "_at_start")
    stops = scan.stops_at(log, times("stop_us")).withColumnRenamed("t", "stop_us").withColumnRenamed("stop_offset", "_at_stop")
    asked = asked.join(starts, [*BY, "start_us"], "left").join(stops, [*BY, "stop_us"], "left")
    p, q = F.col("start_position"), F.col("stop_position")
    newest = F.coalesce("_newest", F.lit(-1).cast("long"))
    start = (
        F.when(p == "OFFSET", F.col("start_offset"))
        .when(p == "TIMESTAMP", F.coalesce("_at_start", F.lit(0).cast("long")))
        .when(p == "EARLIEST", F.coalesce("_oldest", F.lit(-1).cast("long")))
        .when(p == "LATEST", newest)
        .when(p == "NEW_ONLY", newest + 1)
    )
    start = F.when(start < 0, F.lit(0).cast("long")).otherwise(start)
    stop = F.when(q == "OFFSET", F.col("stop_offset")).when(q == "TIMESTAMP", F.col("_at_stop")).when(q == "LATEST", newest)
    wrong_way = F.when(F.col("reverse"), stop > start).otherwise(stop < start)
    error = (
        F.when(F.col("_exists").isNull(), "NO_SUCH_PARTITION")
        .when(start.isNull(), "UNKNOWN_START")
        .when(~q.isin("ON_CANCEL", "OFFSET", "TIMESTAMP", "LATEST"), "UNKNOWN_STOP")
        .when((q == "TIMESTAMP") & stop.isNull(), "STOP_BEFORE_LOG")
        .when((q == "LATEST") & (newest < 0), "EMPTY")
        .when(wrong_way, "STOP_BEFORE_START")
    )
    good = lambda x: F.when(error.isNull(), x)
    return asked.select(*specs.columns, good(start).alias("start"), good(stop).alias("stop"), error.alias("error"))


def read(resolved: DataFrame, log: DataFrame, marks: DataFrame) -> DataFrame:
    """spec_id and the committed records of every request without an error.

    ``marks`` has stream, partition and hw. A start past the watermark is taken back to the first
    offset after it; backwards it is the watermark at most. Requests are the small side of an
    equi-join on the partition.
    """
    wanted = resolved.where("error is null").join(marks, BY)
    low = F.when(F.col("reverse"), F.coalesce("stop", F.lit(0).cast("long"))).otherwise(F.least("start", F.col("hw") + 1))
    high = F.when(F.col("reverse"), F.least("start", "hw")).otherwise(F.least(F.coalesce("stop", "hw"), F.col("hw")))
    wanted = wanted.select("spec_id", *BY, low.alias("_low"), high.alias("_high"))
    return log.join(wanted, BY).where(F.col("offset").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def subscribe(log: DataFrame, spec: Spec, partitions: DataFrame, marks: DataFrame) -> DataFrame:
    """The committed records of one request; raises what the request is refused with.

    The request's one resolved row is looked at before the records are.
    """
    spark = log.sparkSession
    own = (F.col("stream") == spec.stream) & (F.col("partition") == spec.partition)
    log, marks = log.where(own), marks.where(own)
    values = asdict(spec)
    asked = spark.createDataFrame([tuple(values[c.split()[0]] for c in SPEC.split(", "))], SPEC)
    row = resolve(asked, log, partitions).first()
    if row["error"]:
        raise ERRORS[row["error"]](f"{row['error']}: {spec}")
    mark = marks.first()
    hw = mark["hw"] if mark else -1
    if spec.reverse:
        low, high = row["stop"] or 0, min(row["start"], hw)
    else:
        low, high = min(row["start"], hw + 1), hw if row["stop"] is None else min(row["stop"], hw)
    return log.where(F.col("offset").between(low, high))


def exclusive(consumers: DataFrame) -> DataFrame:
    """Of each (group, stream, partition) the consumer that holds it; the others are refused.

    ``consumers`` has group, stream, partition, consumer, group_epoch and seq, the order in which
    they ask. One is refused if a consumer before it has a later epoch, else it replaces that one;
    so the holder is the newest of the greatest epoch.
    """
    best = F.max_by("consumer", F.struct("group_epoch", "seq")).alias("consumer")
    return consumers.groupBy("group", *BY).agg(best, F.max("group_epoch").alias("group_epoch"))


def assigned_records(log: DataFrame, assignments: DataFrame) -> DataFrame:
    """group, member and the records of each assigned partition; assignments are the small side."""
    return assignments.select("group", "member", *BY).join(log, BY)


def check_assignment(asks: DataFrame, groups: DataFrame) -> DataFrame:
    """asks (group, member, epoch) with error: no such group, no member, or another epoch.

    ``groups`` has group, epoch and members. A good ask counts as a heartbeat.
    """
    known = asks.join(groups.withColumnRenamed("epoch", "_epoch"), "group", "left")
    error = (
        F.when(F.col("_epoch").isNull(), "NO_SUCH_GROUP")
        .when(~F.array_contains("members", F.col("member")), "NO_MEMBER")
        .when(F.col("epoch") != F.col("_epoch"), "OTHER_EPOCH")
    )
    return known.select(*asks.columns, error.alias("error"))
