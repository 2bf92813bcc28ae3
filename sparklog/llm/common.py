"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of the white space that separates words, for Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: A character that belongs to a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Spark's setting (4.1; ignored by others) that removes a query's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_root: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where it is unset and Spark runs in this one process, a temporary folder serves.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own_root = _own_root or tempfile.mkdtemp(prefix="sparklog-")
    return f"file://{_own_root}"


def _files(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage like checkpoint(), survives the loss of executors, and keeps the
    columns prunable. The files go with discard(), or when the driver's JVM ends. The shuffles
    that df needed go as soon as it is written, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/sparklog/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    files, jvm_path = _files(spark, path)
    files.deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete what materialize() wrote, once every table that is computed from it is written."""
    for df in stored:
        path = getattr(df, "scratch_path", None)
        if path:
            files, jvm_path = _files(df.sparkSession, path)
            files.delete(jvm_path, True)


def with_row_position(df: DataFrame) -> DataFrame:
    """Add _part and _row, which number the rows; materialize the result before relying on them."""
    return df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})


def gapless_rank(stored: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in the order of _part, _row.

    A key's rows are numbered inside each stored partition, and the counts of the partitions
    before are added, so that a key with most of the rows is still spread over all tasks.
    ``stored`` is a materialized table with with_row_position()'s columns; keys hold no nulls.
    """
    inside = Window.partitionBy(*keys, "_part").orderBy("_row")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        stored.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = stored.withColumn("_in", F.row_number().over(inside) - 1)
    return (
        ranked.join(base, [*keys, "_part"])
        .withColumn(name, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_in", "_base")
    )


def words_of(text: Column) -> Column:
    """The words of a text; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def same_row(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of keys in which null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out
