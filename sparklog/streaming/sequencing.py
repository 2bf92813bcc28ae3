"""Sequencing a stream: the offsets that the batch operator gives, kept as state."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.operators.sequence import sequence


def drain_sequenced(records: DataFrame, root: str, key: str = "partition", order: Sequence[str] = ("ts_us", "event_id"), bucket: Column | None = None) -> DataFrame:
    """Run a stream over everything available and return its records with offsets, from a file.

    Each batch is numbered by sequence() inside (key, bucket), ``bucket`` being the day of ts_us
    unless given, after the next offset of its key, which is all that is kept from one batch to
    the next. Batches go to folders of their own under ``root``, so a repeated one replaces itself.
    """
    spark = records.sparkSession
    bucket = F.floor(F.col("ts_us") / 86_400_000_000) if bucket is None else bucket
    folder = f"{root.rstrip('/')}/sparklog/sequenced-{uuid.uuid4().hex}"
    following = f"{key} {dict(records.dtypes)[key]}, _following long"

    def number(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = session.read.schema(following).parquet(f"{folder}/next/{batch_id - 1}") if batch_id else session.createDataFrame([], following)
        known = known.withColumnRenamed(key, "_key")
        at_key = F.col(key).eqNullSafe(F.col("_key"))
        joined = sequence(batch, [key], order, bucket).join(F.broadcast(known), at_key, "left")
        offset = F.col("offset") + F.coalesce("_following", F.lit(0).cast("long"))
        joined.select(*records.columns, offset.alias("offset")).write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
        counts = batch.groupBy(key).agg(F.count("*").alias("_following"))
        both = counts.unionByName(known.withColumnRenamed("_key", key))
        both.groupBy(key).agg(F.sum("_following").alias("_following")).write.mode("overwrite").parquet(f"{folder}/next/{batch_id}")

    query = records.writeStream.foreachBatch(number).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = f"{', '.join(f'{c} {t}' for c, t in records.dtypes)}, offset long"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")):  # nothing was available
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/log").select(*records.columns, "offset")
