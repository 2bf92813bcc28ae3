"""Assigning dense offsets, rolling segments, finding epochs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, base: Column | int = 0) -> DataFrame:
    """Add ``offset``: dense from ``base`` in each partition, in the order given.

    ``bucket`` must not decrease along the order (such as the day of a leading timestamp). Rows
    are numbered inside (partition, bucket) and start after the counts of the buckets before, so
    one long partition is spread over as many tasks as it has buckets.
    """
    keyed = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = keyed.withColumn("_row", F.row_number().over(inside) - 1)
    base = F.lit(base) if isinstance(base, int) else base
    on, keys = F.lit(True), [*by, "_bucket"]  # null keys and buckets are numbered too
    for c in keys:
        starts = starts.withColumnRenamed(c, f"_of_{c}")
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return (
        numbered.join(starts, on)
        .withColumn("offset", (F.col("_start") + F.col("_row") + base).cast("long"))
        .drop("_bucket", "_row", "_start", *(f"_of_{c}" for c in keys))
    )


def fold_in_order(df: DataFrame, by: Sequence[str], order: str, value: str, step: Callable, start: object, results: dict[str, str]) -> DataFrame:
    """by, order and results: a fold over each partition's rows in order.

    ``step(state, order, value)`` returns the next state and the row's results. Rows are sorted by
    Spark, which spills, and pass in batches, so that a task holds a batch and a state however
    long the partition is; but the rows of one partition pass through one task.
    """
    slim = df.select(*by, order, value).repartition(*by).sortWithinPartitions(*by, order)
    kinds, n = dict(slim.dtypes), len(by)
    types = [{"long": pa.int64(), "boolean": pa.bool_()}[t] for t in results.values()]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    key, state = row[:n], start
                state, result = step(state, row[n], row[n + 1])
                out.append(result)
            added = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *added], names=[*by, order, *results])

    schema = ", ".join([f"{c} {kinds[c]}" for c in (*by, order)] + [f"{c} {t}" for c, t in results.items()])
    return slim.mapInArrow(go, schema)


def roll_segments(log: DataFrame, max_bytes: int, by: Sequence[str] = ("stream", "partition"), max_age_us: int = 0) -> DataFrame:
    """Add ``segment``, the base offset of the segment that each record falls in.

    A record opens a new segment if the current one has max_bytes or more, or if max_age_us (0:
    never) have passed since its first write. Both restart at each segment, so this is a fold
    over a partition's sizes and times in order; only those enter Python, and state is three
    numbers.
    """

    def step(state, offset, record):
        base, held, since = state
        size, at = (record, 0) if isinstance(record, int) else (record["size"], record["at"])
        if base is None or held >= max_bytes or (max_age_us and at - since >= max_age_us):
            base, held, since = offset, 0, at
        return (base, held + size, since), (base,)

    slim, value = log, "size_bytes"
    if max_age_us:
        slim, value = log.withColumn("_record", F.struct(F.col("size_bytes").alias("size"), F.col("ts_us").alias("at"))), "_record"
    return log.join(fold_in_order(slim, by, "offset", value, step, (None, 0, 0), {"segment": "long"}), [*by, "offset"])


def accept_expected(attempts: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Optimistic concurrency: add ``accepted`` and ``offset``.

    An attempt is accepted if its expected offset is -1 or the next offset; a rejected one takes
    no offset. A fold for each partition.
    """

    def step(following, _, expected):
        good = expected in (-1, following)
        return following + good, (good, following if good else None)

    return fold_in_order(attempts, by, order, "expected", step, 0, {"accepted": "boolean", "offset": "long"})


def epoch_starts(log: DataFrame, by: Sequence[str] = ("stream", "partition")) -> DataFrame:
    """The first offset of every leader epoch."""
    return log.groupBy(*by, "leader_epoch").agg(F.min("offset").alias("start_offset"))


def last_offset_for_epoch(log: DataFrame, epochs: DataFrame, by: Sequence[str] = ("stream", "partition")) -> DataFrame:
    """For each asked epoch the start of the next larger one, or else the newest offset.

    ``epochs`` has asked, alone or with by. One pass over the log gives each partition's epochs
    with their starts and its newest offset; asked epochs join them by equality or fall between two.
    """
    runs = log.groupBy(*by, "leader_epoch").agg(F.min("offset").alias("start_offset"), F.max("offset").alias("end_offset"))
    line = Window.partitionBy(*by).orderBy("leader_epoch")
    after = F.first("start_offset").over(line.rowsBetween(1, Window.unboundedFollowing))
    newest = F.max("end_offset").over(Window.partitionBy(*by))
    first = F.row_number().over(line) == 1
    # [from, until) is the range of asked epochs that each run answers; the first also answers all before it
    steps = runs.select(*by, "leader_epoch", "start_offset", F.coalesce(after, newest).alias("answer"), first.alias("first"), F.lead("leader_epoch").over(line).alias("until"))
    before = steps.where("first").select(*by, F.lit(None).cast("long").alias("since"), F.col("leader_epoch").alias("until"), F.col("start_offset").alias("answer"))
    ranges = steps.select(*by, F.col("leader_epoch").alias("since"), "until", "answer").unionByName(before)
    inside = (F.col("since").isNull() | (F.col("asked") >= F.col("since"))) & (F.col("until").isNull() | (F.col("asked") < F.col("until")))
    if epochs.columns == ["asked"]:
        listed = epochs.agg(F.sort_array(F.collect_set("asked")).alias("_all"))  # distinct epochs, few
        return ranges.join(F.broadcast(listed), F.lit(True)).select("*", F.explode("_all").alias("asked")).where(inside).select(*by, "asked", F.col("answer").alias("last_offset"))
    return ranges.join(epochs, [*by]).where(inside).select(*by, "asked", F.col("answer").alias("last_offset"))
