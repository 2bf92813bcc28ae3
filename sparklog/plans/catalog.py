"""The catalog as a fold of an ordered operation log, and the activity stream it publishes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.functions.scalar import valid_subject
from sparklog.schema import RESERVED_STREAMS

#: Operations that become activity events, and the events' names.
ACTIVITY = {
    "create_stream": "CREATE_STREAM",
    "delete_stream": "DELETE_STREAM",
    "pause_stream": "PAUSE_STREAM",
    "resume_stream": "RESUME_STREAM",
    "set_readonly": "SET_STREAM_READONLY",
    "create_group": "JOIN_CONSUMER_GROUP",
    "join_group": "JOIN_CONSUMER_GROUP",
    "leave_group": "LEAVE_CONSUMER_GROUP",
}


def activity(ops: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """id, event and name of every operation that is published; order by id to publish them."""
    event = None
    for op, name in ACTIVITY.items():
        event = F.when(F.col("op") == op, name) if event is None else event.when(F.col("op") == op, name)
    return ops.select(F.col("index").alias("id"), event.alias("event"), "name", *keep).where(F.col("event").isNotNull())


def deduplicate(events: DataFrame) -> DataFrame:
    """Events are delivered at least once; their ids tell copies."""
    return events.dropDuplicates(["id"])


def fold(ops: DataFrame) -> DataFrame:
    """The streams that exist after all operations (index, op, name), with their state.

    Each attribute is overwritten by the newest operation on it, so the fold is a max_by for
    each stream: deletes tombstone, a later create starts anew with its index as epoch, and only
    operations after the newest create count.
    """
    last = lambda *names: F.max(F.when(F.col("op").isin(*names), F.col("index")))
    newest = ops.groupBy("name").agg(
        last("create_stream").alias("created"),
        last("delete_stream").alias("deleted"),
        last("pause_stream").alias("paused_at"),
        last("resume_stream").alias("resumed_at"),
        last("set_readonly").alias("readonly_at"),
    )
    since = lambda c: F.coalesce(F.when(F.col(c) > F.col("created"), F.col(c)), F.lit(-1).cast("long"))
    alive = newest.where("created is not null and (deleted is null or deleted < created)")
    return alive.select(
        "name", F.col("created").alias("epoch"), (since("paused_at") > since("resumed_at")).alias("paused"), (since("readonly_at") >= 0).alias("readonly")
    )


def create_requests(requests: DataFrame) -> DataFrame:
    """Requests (name, subject, partitions, factor) with their defaults and error (null: none).

    0 partitions or a factor of 0 stand for 1; a factor of -1 for all brokers.
    """
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c)).cast("int")
    error = (
        F.when(F.coalesce(F.col("name"), F.lit("")) == "", "NO_NAME")
        .when(F.col("name").isin(*RESERVED_STREAMS), "RESERVED")
        .when(F.coalesce(F.col("subject"), F.lit("")) == "", "NO_SUBJECT")
        .when(~valid_subject(F.col("subject")), "BAD_SUBJECT")
    )
    return requests.withColumns({"partitions": one("partitions"), "factor": one("factor"), "error": error})


def internal_streams(spark: SparkSession, cursor_partitions: int) -> DataFrame:
    """The reserved streams: cursors, compacted, if they have partitions; activity, on all brokers."""
    rows = [("__cursors", cursor_partitions, -1, True)] if cursor_partitions > 0 else []
    return spark.createDataFrame([*rows, ("__activity", 1, -1, False)], "name string, partitions int, factor int, compact boolean")


def apply(ops: DataFrame) -> DataFrame:
    """ops with error (null: it takes effect), epoch and width, the stream's epoch and partitions then.

    ``ops`` has index, op (create_stream, delete_stream, pause_stream, resume_stream,
    set_readonly), name, n (partitions of a create) and partitions (of the others; empty: all).
    Whether a stream exists before an operation is told by the newest create or delete before it,
    refused or not; its epoch is the index of the create that found none. A stream's operations
    are one window.
    """
    line = Window.partitionBy("name").orderBy("index")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    is_create, is_delete = F.col("op") == "create_stream", F.col("op") == "delete_stream"
    last = F.last(F.when(is_create | is_delete, is_create), ignorenulls=True).over(before)
    known = ops.withColumn("_exists", F.coalesce(last, F.lit(False)))
    made = is_create & ~F.col("_exists")
    known = known.withColumns(
        {"epoch": F.last(F.when(made, F.col("index")), ignorenulls=True).over(upto), "width": F.last(F.when(made, F.col("n")), ignorenulls=True).over(upto)}
    )
    outside = F.exists(F.coalesce("partitions", F.array().cast("array<int>")), lambda p: (p < 0) | (p >= F.col("width")))
    error = (
        F.when(is_create & F.col("_exists"), "ALREADY_EXISTS")
        .when(~is_create & ~F.col("_exists"), "NOT_FOUND")
        .when(~is_create & ~is_delete & outside, "NO_SUCH_PARTITION")
    )
    return known.withColumn("error", error).drop("_exists")


def fold_partitions(ops: DataFrame) -> DataFrame:
    """name, partition, epoch, paused and readonly of every partition that exists after all ops.

    ``ops`` as for apply(), with flag for set_readonly (false: writable again). Only operations
    that took effect in a stream's last life count; each attribute is its newest operation's.
    """
    done = apply(ops).where("error is null")
    made = F.max(F.when(F.col("op") == "create_stream", F.struct("index", "n"))).alias("made")
    gone = F.max(F.when(F.col("op") == "delete_stream", F.col("index"))).alias("gone")
    alive = done.groupBy("name").agg(made, gone).where("made is not null and (gone is null or gone < made.index)")
    alive = alive.select("name", F.col("made.index").alias("epoch"), F.explode(F.sequence(F.lit(0), F.col("made.n") - 1)).alias("partition"))
    listed = F.coalesce("partitions", F.array().cast("array<int>"))
    every = F.when(F.size(listed) == 0, F.sequence(F.lit(0), F.col("width") - 1)).otherwise(listed)
    touched = done.where(F.col("op").isin("pause_stream", "resume_stream", "set_readonly"))
    touched = touched.select("name", "epoch", "index", "op", "flag", F.explode(every).alias("partition"))
    moves = F.col("op").isin("pause_stream", "resume_stream")
    newest = touched.groupBy("name", "epoch", "partition").agg(
        F.max_by(F.col("op") == "pause_stream", F.when(moves, F.col("index"))).alias("paused"),
        F.max_by("flag", F.when(F.col("op") == "set_readonly", F.col("index"))).alias("readonly"),
    )
    state = alive.join(newest, ["name", "epoch", "partition"], "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return state.select("name", "partition", "epoch", no("paused"), no("readonly"))


def fenced(ops: DataFrame, by: Sequence[str]) -> DataFrame:
    """ops (by, index, epoch) that take effect: those with an epoch above all before them."""
    before = Window.partitionBy(*by).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("_seen", F.coalesce(F.max("epoch").over(before), F.lit(-1).cast("long"))).where("epoch > _seen").drop("_seen")


def fold_isr(ops: DataFrame, replicas: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, isr and leader after shrink_isr, expand_isr and change_leader (by, index, epoch, op, replica).

    ``replicas`` has by, replicas (all in sync at first) and leader. A replica is in sync unless
    its newest operation that took effect took it out.
    """
    done = fenced(ops, by)
    moved = done.where(F.col("op").isin("shrink_isr", "expand_isr")).groupBy(*by, "replica").agg(F.max_by("op", "index").alias("op"))
    out = moved.where("op = 'shrink_isr'").groupBy(*by).agg(F.collect_set("replica").alias("_out"))
    leaders = done.where("op = 'change_leader'").groupBy(*by).agg(F.max_by("replica", "index").alias("_leader"))
    known = replicas.join(out, [*by], "left").join(leaders, [*by], "left")
    isr = F.array_sort(F.array_except("replicas", F.coalesce("_out", F.array().cast(known.schema["replicas"].dataType))))
    return known.select(*by, isr.alias("isr"), F.coalesce("_leader", "leader").alias("leader"))


def partition_metadata(partitions: DataFrame, bounds: DataFrame, times: DataFrame) -> DataFrame:
    """A struct of what is told of each partition: newest offset, watermark, and for each kind of
    event in times (stream, partition, kind, ts_us) its first and latest time, 0 if it never was."""
    pair = lambda kind: F.struct(
        F.coalesce(F.min(F.when(F.col("kind") == kind, F.col("ts_us"))), F.lit(0).cast("long")).alias("first"),
        F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("ts_us"))), F.lit(0).cast("long")).alias("latest"),
    )
    seen = times.groupBy("stream", "partition").agg(*(pair(k).alias(k) for k in ("received", "pause", "readonly")))
    never = F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("latest"))
    joined = partitions.join(bounds, ["stream", "partition"], "left").join(seen, ["stream", "partition"], "left")
    none = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    rest = [c for c in partitions.columns if c not in ("stream", "partition")]
    about = F.struct("partition", *rest, none("hw"), none("newest"), *(F.coalesce(k, never).alias(k) for k in ("received", "pause", "readonly")))
    return joined.select("stream", about.alias("about"))


def requested(asked: DataFrame, known: DataFrame, key: str, error: str, all_if_empty: bool) -> DataFrame:
    """known rows of the asked keys, each unknown key with an error; no keys: all rows, or none."""
    found = asked.join(known.withColumn("_known", F.lit(True)), key, "left")
    found = found.withColumn("error", F.when(F.col("_known").isNull(), error)).drop("_known")
    if not all_if_empty or not asked.isEmpty():
        return found
    return known.withColumn("error", F.lit(None).cast("string")).select(*found.columns)


def broker_loads(brokers: DataFrame, partitions: DataFrame, groups: DataFrame) -> DataFrame:
    """id and how many partitions, leaders and coordinators each broker has."""
    held = partitions.select(F.explode("replicas").alias("id")).groupBy("id").agg(F.count("*").alias("partitions"))
    leads = partitions.groupBy(F.col("leader").alias("id")).agg(F.count("*").alias("leaders"))
    heads = groups.groupBy(F.col("coordinator").alias("id")).agg(F.count("*").alias("coordinators"))
    out = brokers.select("id")
    for part in (held, leads, heads):
        out = out.join(part, "id", "left")
    return out.na.fill(0)


def save_snapshot(path: str, **tables: DataFrame) -> None:
    """The catalog's tables, such as streams and groups, each as a Parquet folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore_snapshot(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]


def subscriber_counts(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and the number of subscribers after all changes (+1, -1), never below 0."""
    return changes.groupBy(*by).agg(F.greatest(F.sum("change"), F.lit(0)).alias("subscribers"))


def is_idle(now: Column, last: Column, limit: Column | int, subscribers: Column, only_without: Column) -> Column:
    """Whether a partition is to be paused: idle for longer than limit, and, where subscribers
    hold a pause off, without any."""
    return (now - last > limit) & (~only_without | (subscribers == 0))
