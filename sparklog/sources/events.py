"""Logs out of the test tables: each event is a record of the stream ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog import scratch
from sparklog.operators.sequence import sequence
from sparklog.sources.stored import StoredLog

PARTITIONS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsequenced records: keyed by user, partitioned by user, stamped in microseconds."""
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("stream"),
        F.pmod("user_id", F.lit(PARTITIONS)).cast("int").alias("partition"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        "event_type",
        "user_id",
        "event_id",
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence(raw_events(spark, sf_dir), ["stream", "partition"], ["ts_us", "event_id"], bucket=F.floor(F.col("ts_us") / 86_400_000_000))


_stored: dict[tuple[str, str], str] = {}


def stored_events(spark: SparkSession, sf_dir: str, behind: int = 10) -> StoredLog:
    """The events as a stored log, appended once in a session; the watermark lies some records back."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _stored:
        return StoredLog(spark, _stored[key])
    log = StoredLog(spark, scratch.folder(spark, "events"))
    log.append(raw_events(spark, sf_dir), ["ts_us", "event_id"], F.floor(F.col("ts_us") / 86_400_000_000))
    log.commit(log.state().select("stream", "partition", (F.col("next") - 1 - behind).alias("hw")))
    _stored[key] = log.path
    return log
