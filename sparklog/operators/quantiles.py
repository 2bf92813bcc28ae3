"""Exact quantiles of grouped values by running sums."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Equal ranges between a group's least and greatest value.
RANGES = 1000


def summary(df: DataFrame, by: str, value: str, at: Mapping[str, float]) -> DataFrame:
    """by, least, most, mean and the interpolated quantiles of the values that are not null.

    Equal values are counted first. Counts are summed up inside (group, range of values) and
    start after the sums of the ranges before, so no buffer holds the values of a group.
    """
    whole = df.groupBy(by).agg(
        F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count(value).alias("_total")
    )
    line = F.broadcast(whole.select(F.col(by).alias("_by"), "least", "most", "_total"))
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counts = counts.join(line, F.col(by).eqNullSafe(F.col("_by")))
    place = F.floor((F.col("_v") - F.col("least")) / (F.col("most") - F.col("least")) * RANGES)
    counts = counts.withColumn("_range", F.when(F.col("most") > F.col("least"), place).otherwise(F.lit(0)).cast("long"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(by, "_range").agg(F.sum("_n").alias("_s"))
    starts = sums.select(F.col(by).alias("_by2"), F.col("_range").alias("_r2"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_in", F.sum("_n").over(inside))
    placed = placed.join(starts, F.col(by).eqNullSafe(F.col("_by2")) & (F.col("_range") == F.col("_r2")))
    end = F.col("_start") + F.col("_in")

    picks = []
    for name, q in at.items():
        where = F.lit(float(q)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(where)), ("hi", F.ceil(where))):
            picks.append(F.max(F.when((end - F.col("_n") <= rank) & (rank < end), F.col("_v"))).alias(f"_{name}_{side}"))
    found = placed.groupBy(F.col(by).alias("_by")).agg(*picks)
    out = whole.join(found, F.col(by).eqNullSafe(F.col("_by")), "left")
    columns = [by, "least", "most", "mean"]
    for name, q in at.items():
        where = F.lit(float(q)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        columns.append((lo + (hi - lo) * (where - F.floor(where))).alias(name))
    return out.select(*columns)
