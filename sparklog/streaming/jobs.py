"""Streaming forms of the log's operators, each run over all that is available, into files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.operators.sequence import accept_expected
from sparklog.plans import catalog


def drain(stream: DataFrame, root: str, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available; its rows, from the files it wrote."""
    spark = stream.sparkSession
    folder = f"{root.rstrip('/')}/sparklog/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def each_batch(stream: DataFrame, root: str, handler: Callable[[DataFrame, int], None]) -> None:
    """Call handler(batch, number) for every micro-batch; one may come again after a failure."""
    folder = f"{root.rstrip('/')}/sparklog/handler-{uuid.uuid4().hex}"
    query = stream.writeStream.foreachBatch(handler).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()


def tail(spark: SparkSession, path: str, schema: str, stream: str, partition: int) -> DataFrame:
    """A stored partition's records as a stream, new files as they come."""
    rows = spark.readStream.schema(schema).option("basePath", path).parquet(path)
    return rows.where((F.col("stream") == stream) & (F.col("partition") == partition))


def accept_stream(attempts: DataFrame, root: str, key: str, order: str) -> DataFrame:
    """Optimistic concurrency over a stream: key, order, accepted and offset of every attempt.

    ``attempts`` has key, order and expected. The next offset of each key is all that one batch
    leaves to the next; expectations are taken relative to it, so that a batch is the batch
    operator's fold from 0. A batch that comes again replaces its own files.
    """
    spark = attempts.sparkSession
    kinds = dict(attempts.dtypes)
    folder = f"{root.rstrip('/')}/sparklog/accepted-{uuid.uuid4().hex}"
    state = f"{key} {kinds[key]}, _next long"

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = session.read.schema(state).parquet(f"{folder}/next/{number - 1}") if number else session.createDataFrame([], state)
        base = F.coalesce("_next", F.lit(0).cast("long"))
        joined = batch.join(F.broadcast(known), key, "left")
        # an offset before the base can't be the next one: -2 never is
        wanted = F.when(F.col("expected") == -1, -1).when(F.col("expected") < base, -2).otherwise(F.col("expected") - base)
        tried = accept_expected(joined.select(key, order, wanted.cast("long").alias("expected")), [key], order)
        tried = tried.join(F.broadcast(known), key, "left").withColumn("offset", F.col("offset") + base).drop("_next")
        tried.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        done = session.read.schema(f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean, offset long").parquet(f"{folder}/log/batch={number}")
        moved = done.where("accepted").groupBy(key).agg((F.max("offset") + 1).alias("_next"))
        both = known.unionByName(moved).groupBy(key).agg(F.max("_next").alias("_next"))
        both.write.mode("overwrite").parquet(f"{folder}/next/{number}")

    each_batch(attempts, root, fold)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean, offset long"
    return spark.read.schema(schema).parquet(f"{folder}/log").select(key, order, "accepted", "offset")


def quiet_since(events: DataFrame, by: Sequence[str], time: str, timeout: str, delay: str = "0 seconds") -> DataFrame:
    """by, first, last and beats of every run of events that has ended: nothing came for timeout.

    For consumers it is their expiry, for partitions their automatic pause. State is a session for
    each key; one is told once the stream's time has passed its end.
    """
    sessions = events.withWatermark(time, delay).groupBy(*by, F.session_window(time, timeout).alias("_session"))
    return sessions.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("beats")).drop("_session")


def activity_stream(ops: DataFrame, time: str, memory: str = "1 hour") -> DataFrame:
    """The activity events of a stream of operations (index, op, name, time), copies told by id."""
    sent = catalog.activity(ops.withWatermark(time, memory), keep=[time])
    return sent.dropDuplicatesWithinWatermark(["id"])
