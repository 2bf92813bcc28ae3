"""A log as Parquet files: appended in batches, read by stream, partition and offset.

Files lie under ``log/stream=.../partition=...`` and are sorted by offset, so a read of one
partition opens its folder alone, and offset bounds skip row groups by their statistics. What an
append has to know of the log is one row for each partition (next offset, segment, epoch,
watermark), written anew with each batch as ``state/<version>`` after the batch's records; a
batch that fails before that is not part of the log, as readers stop at the state's next offset.
One writer appends at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.errors import FailedPrecondition
from sparklog.functions.record import record_size
from sparklog.operators.sequence import sequence

BY = ["stream", "partition"]
_STATE = "stream string, partition int, next long, segment long, segment_bytes long, segment_since long, leader_epoch long, hw long, readonly boolean, cuts array<struct<batch:int,offset:long>>"


class StoredLog:
    """The verbs of a log's storage: append, append_sequenced, scan, state, commit, truncate, delete."""

    def __init__(self, spark: SparkSession, path: str, max_segment_bytes: int = 256 << 20, max_segment_us: int = 0) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.max_bytes, self.max_us = max_segment_bytes, max_segment_us

    # -- what is known of each partition

    def _files(self, name: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _version(self) -> int:
        files, folder = self._files("state")
        names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
        # a version counts once its success file is there
        done = [int(n) for n in names if n.isdigit() and files.exists(self._files(f"state/{n}/_SUCCESS")[1])]
        return max(done, default=-1)

    def state(self) -> DataFrame:
        """A row for each partition: next offset, open segment, epoch, watermark, read-only."""
        version = self._version()
        if version < 0:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/state/{version}")

    def _set_state(self, state: DataFrame) -> None:
        columns = self.spark.createDataFrame([], _STATE).columns
        state.select(*columns).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{self._version() + 1}")

    def _change(self, rows: DataFrame, **columns: Column) -> None:
        """Set columns of the partitions in rows (stream, partition and what the columns refer to)."""
        known = self.state()
        rest = known.join(rows.select(*BY), BY, "left_anti")
        changed = known.join(rows, BY).withColumns(columns).select(*known.columns)
        self._set_state(rest.unionByName(changed))

    # -- writing

    def append(self, records: DataFrame, order: Sequence[str], bucket: Column, epoch: int = 0) -> None:
        """Assign offsets after the partition's last one, in the order given, and write the records.

        ``records`` has stream, partition, ts_us, key, value and maybe headers and more. A batch
        rolls the open segment at most once, before its first record, if that has reached the
        size or age. A read-only partition refuses.
        """
        known = self.state()
        if not records.join(known.where("readonly"), BY, "left_semi").isEmpty():
            raise FailedPrecondition("a partition is read-only")
        headers = "headers" if "headers" in records.columns else None
        numbered = sequence(records.withColumn("size_bytes", record_size(headers=headers)), BY, order, bucket)
        base = known.select(*BY, F.col("next").alias("_next"), F.col("segment").alias("_segment"), "segment_bytes", "segment_since")
        joined = numbered.join(base, BY, "left").withColumn("offset", F.col("offset") + F.coalesce("_next", F.lit(0).cast("long")))
        firsts = numbered.groupBy(*BY).agg(F.min_by("ts_us", "offset").alias("_first_us"))
        joined = joined.join(firsts, BY)
        full = F.col("segment_bytes") >= self.max_bytes
        if self.max_us:
            full = full | (F.col("_first_us") - F.col("segment_since") >= self.max_us)
        start = F.when(F.col("_segment").isNull() | full, F.coalesce("_next", F.lit(0).cast("long"))).otherwise(F.col("_segment"))
        rows = joined.select(*records.columns, "offset", "size_bytes", start.alias("segment"), F.lit(epoch).cast("long").alias("leader_epoch"))
        self._write(rows)

    def append_sequenced(self, rows: DataFrame) -> None:
        """Write records that have offsets, segments, sizes and epochs already; read-only ones too."""
        self._write(rows)

    def _write(self, rows: DataFrame) -> None:
        """Records first, then the state; both come from what was written."""
        version = self._version() + 1
        folder = f"{self.path}/log/batch={version}"
        day = F.floor(F.col("ts_us") / 86_400_000_000)
        spread = rows.repartition(*BY, day).sortWithinPartitions(*BY, "offset")
        spread.write.mode("overwrite").partitionBy(*BY).parquet(folder)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        new = self.spark.read.schema(kinds).parquet(folder)
        last = new.groupBy(*BY).agg((F.max("offset") + 1).alias("n"), F.max("segment").alias("s"), F.max("leader_epoch").alias("e"))
        here = new.join(last.select(*BY, "s"), BY).where("segment = s").groupBy(*BY).agg(F.sum("size_bytes").alias("b"), F.min("ts_us").alias("since"))
        new = last.join(here, BY).withColumnsRenamed({"s": "new_segment"})
        both = self.state().join(new, BY, "full")
        goes_on = F.col("segment") == F.col("new_segment")
        state = both.select(
            *BY,
            F.coalesce("n", "next").alias("next"),
            F.coalesce("new_segment", "segment").alias("segment"),
            F.when(F.col("new_segment").isNull(), F.col("segment_bytes")).when(goes_on, F.col("segment_bytes") + F.col("b")).otherwise(F.col("b")).alias("segment_bytes"),
            F.when(F.col("new_segment").isNull() | goes_on, F.col("segment_since")).otherwise(F.col("since")).alias("segment_since"),
            F.greatest(F.coalesce("leader_epoch", F.lit(0).cast("long")), F.coalesce("e", F.lit(0).cast("long"))).alias("leader_epoch"),
            F.coalesce("hw", F.lit(-1).cast("long")).alias("hw"),
            F.coalesce("readonly", F.lit(False)).alias("readonly"),
            F.coalesce("cuts", F.array().cast("array<struct<batch:int,offset:long>>")).alias("cuts"),
        )
        self._set_state(state)

    def commit(self, marks: DataFrame) -> None:
        """Raise watermarks to those in marks (stream, partition, hw); they never fall."""
        self._change(marks.withColumnRenamed("hw", "_hw"), hw=F.greatest("hw", "_hw"))

    def set_readonly(self, stream: str, partitions: Sequence[int] = (), readonly: bool = True) -> None:
        """Some partitions of a stream, or all."""
        rows = self.state().where(F.col("stream") == stream).select(*BY)
        rows = rows.where(F.col("partition").isin(*partitions)) if partitions else rows
        self._change(rows, readonly=F.lit(readonly))

    def truncate(self, stream: str, partition: int, offset: int) -> None:
        """Drop the partition's records from this offset on.

        The state notes the cut: records that lie in batches up to now at or past it are none.
        """
        held = self.scan(stream, partition).where(F.col("offset") < offset)
        last = held.agg(F.max("segment").alias("_s"), F.max("leader_epoch").alias("_e")).select(F.lit(stream).alias("stream"), F.lit(partition).alias("partition"), "_s", "_e")
        size = held.groupBy("segment").agg(F.sum("size_bytes").alias("_b"), F.min("ts_us").alias("_since"))
        rows = last.join(size, last["_s"] == size["segment"], "left").drop("segment")
        cut = F.struct(F.lit(self._version()).alias("batch"), F.lit(offset).cast("long").alias("offset"))
        self._change(
            rows,
            next=F.least("next", F.lit(offset)),
            segment=F.coalesce("_s", F.lit(0).cast("long")),
            segment_bytes=F.coalesce("_b", F.lit(0).cast("long")),
            segment_since=F.col("_since"),
            leader_epoch=F.coalesce("_e", F.lit(0).cast("long")),
            hw=F.least("hw", F.lit(offset - 1)),
            cuts=F.array_append("cuts", cut),
        )

    def delete(self) -> None:
        files, path = self._files("")
        files.delete(path, True)

    # -- reading

    def scan(self, stream: str | None = None, partition: int | None = None) -> DataFrame:
        """The records that the state covers; of one stream or partition, by their folders alone."""
        rows, state = self._rows(), self.state().select(*BY, "next", "cuts")
        for name, value in (("stream", stream), ("partition", partition)):
            if value is not None:
                rows, state = rows.where(F.col(name) == value), state.where(F.col(name) == value)
        gone = F.exists("cuts", lambda c: (F.col("batch") <= c["batch"]) & (F.col("offset") >= c["offset"]))
        return rows.join(F.broadcast(state), BY).where((F.col("offset") < F.col("next")) & ~gone).drop("next", "cuts", "batch")

    def _rows(self) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        return rows.withColumn("partition", F.col("partition").cast("int"))

    def committed(self, stream: str, partition: int, start: int = 0, stop: int | None = None) -> DataFrame:
        """Records from start to stop, inclusive, and no further than the watermark.

        The state's one row is read first, so that all bounds reach the scan as numbers. A start
        past the watermark is taken back to the first offset after it.
        """
        row = self.state().where((F.col("stream") == stream) & (F.col("partition") == partition)).first()
        hw = row["hw"] if row else -1
        start = min(max(start, 0), hw + 1)
        last = hw if stop is None else min(stop, hw)
        rows = self.spark.read.option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        rows = rows.where((F.col("stream") == stream) & (F.col("partition") == partition) & F.col("offset").between(start, last))
        for cut in row["cuts"] if row else ():
            rows = rows.where((F.col("batch") > cut["batch"]) | (F.col("offset") < cut["offset"]))
        return rows.drop("batch")

    def segment(self, stream: str, partition: int, base: int, newest_first: bool = False, start: int | None = None) -> DataFrame:
        """One segment's records with their rank in reading order; backwards from ``start`` if given."""
        rows = self.scan(stream, partition).where(F.col("segment") == base)
        if newest_first and start is not None:
            rows = rows.where(F.col("offset") <= start)
        line = Window.partitionBy("segment").orderBy(F.desc("offset") if newest_first else "offset")
        return rows.withColumn("rank", F.row_number().over(line).cast("long"))
