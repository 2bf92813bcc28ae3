"""Messages to measure with, and what is reported of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bench_messages(spark: SparkSession, n: int, size: int) -> DataFrame:
    """id, key and a value of ``size`` bytes for each of n messages."""
    return spark.range(n).select("id", F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"), F.rpad(F.lit(""), size, "x").alias("value"))


def bench_report(messages: DataFrame, seconds: float) -> DataFrame:
    """One row: sent, received, bytes, errors, and both rates, of messages with value and error."""
    size = F.sum(F.octet_length("value"))
    return messages.agg(
        F.count("*").alias("sent"),
        F.count_if(~F.col("error")).alias("received"),
        size.alias("bytes"),
        F.count_if("error").alias("errors"),
        (F.count("*") / seconds).alias("per_second"),
        F.round(size / seconds / (1 << 20), 6).alias("mb_per_second"),
    )
