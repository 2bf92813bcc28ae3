"""Folds of a partition that is longer than a batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from sparklog.operators import quantiles
from sparklog.operators import sequence as seq

ROWS = 5_000


@pytest.fixture(params=[7, 10_000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(request.param))
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def uneven(spark):
    """A hot partition with nine tenths of the rows, and offsets in no order."""
    ids = spark.range(ROWS, numPartitions=5).select((F.lit(ROWS - 1) - F.col("id")).alias("id"))
    part = F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(F.lit(9)).cast("int")
    return ids.select(F.lit("s").alias("stream"), part.alias("partition"), F.col("id").alias("offset"), (F.col("id") % 97 + 1).alias("size_bytes"))


def by_partition(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["offset"]):
        out.setdefault(r["partition"], []).append(r)
    return out


def test_rolling_of_a_hot_partition(spark, batches):
    log = uneven(spark)
    got = {r["offset"]: r["segment"] for r in seq.roll_segments(log, 300).collect()}
    wanted = {}
    for rows in by_partition(log).values():
        base, held = None, 0
        for r in rows:
            if base is None or held >= 300:
                base, held = r["offset"], 0
            held += r["size_bytes"]
            wanted[r["offset"]] = base
    assert got == wanted and len(got) == ROWS


def test_acceptance_in_a_hot_partition(spark, batches):
    tried = uneven(spark).withColumn("expected", F.when(F.col("offset") % 3 == 0, -1).when(F.col("offset") % 7 == 0, None).otherwise(F.floor(F.col("offset") / 4)).cast("long"))
    got = {r["offset0"]: (r["accepted"], r["offset"]) for r in seq.accept_expected(tried.withColumnRenamed("offset", "offset0"), ["partition"], "offset0").collect()}
    wanted = {}
    for rows in by_partition(tried).values():
        following = 0
        for r in rows:
            good = r["expected"] in (-1, following)
            wanted[r["offset"]] = (good, following if good else None)
            following += good
    assert got == wanted and len(got) == ROWS


def test_no_whole_partition_is_a_pandas_frame(spark):
    tried = uneven(spark).withColumn("expected", F.lit(-1).cast("long")).withColumnRenamed("offset", "n")
    for df in (seq.roll_segments(uneven(spark), 300), seq.accept_expected(tried, ["partition"], "n")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_quantiles_of_skewed_values_without_a_buffer(spark):
    import numpy as np

    groups = {"one": [4.0], "equal": [2.5] * 50, "far": [*range(400), 1e9], None: [float(i % 7) for i in range(301)], "nothing": [None]}
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    at = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p1": 1.0}
    found = quantiles.summary(df, "g", "v", at)
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["g"]: r for r in found.collect()}
    assert got.keys() == groups.keys() and got["nothing"]["p50"] is None
    for g, vs in groups.items():
        if g != "nothing":
            assert [got[g][c] for c in ("least", "most", "mean")] == pytest.approx([min(vs), max(vs), np.mean(vs)])
            assert [got[g][c] for c in at] == pytest.approx([np.quantile(vs, q) for q in at.values()])
