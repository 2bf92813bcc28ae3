"""What the second review found: queries on tables made for it, held against their SQL."""

from __future__ import annotations

import datetime
import re
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same
from pyspark.sql import functions as F
from sparklog import queries, queries_service
from sparklog.llm import common
from sparklog.operators import publish

assert queries_service


def events(path, rows):
    """A table of events out of (event_id, user_id, event_type)."""
    ids, users, kinds = zip(*rows, strict=True)
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i) for i in range(len(rows))]
    columns = {"event_id": pa.array(ids, pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array(users, pa.int64())}
    columns |= {"event_type": pa.array(kinds, pa.string()), "value": pa.array([1.0] * len(rows)), "props": pa.array(["{}"] * len(rows))}
    pq.write_table(pa.table(columns), f"{path}/events.parquet")
    return str(path)


def same(spark, name, path):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], path)


def test_isr_of_a_partition_that_all_replicas_left(spark, tmp_path):
    """Ids 5, 10 and 15 shrink the replicas 2, 1 and 0 of partition 1 with growing epochs; some ids and users are negative."""
    same(spark, "isr_fold", events(tmp_path, [(5, 1, "view"), (10, 1, "view"), (15, 1, "view"), (22, 2, "view"), (-3, 3, "view"), (30, -2, "view")]))


@pytest.fixture
def no_small_tables(spark):
    """Spark takes no table for small by itself, and plans are final."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_values_are_not_shuffled_by_stream(spark, no_small_tables):
    """One stream can have most of the messages."""
    streams = spark.createDataFrame([("hot", 2, False, False), ("shut", 1, True, False)], "stream string, partitions int, readonly boolean, occ boolean")
    rows = [(i, "hot", i % 3, bytes(i % 7), "ALL", None) for i in range(40)]
    rows += [(40, "shut", 0, b"", "ALL", None), (41, "none", 0, b"", "ALL", None), (42, None, 0, b"", "ALL", None), (43, "__cursors", 0, b"", "ALL", None)]
    sent = spark.createDataFrame(rows, "id long, stream string, partition int, value binary, ack_policy string, expected_offset long")
    checked = publish.refuse(sent, streams, max_bytes=5)
    assert "Exchange hashpartitioning" not in plan(checked)
    hot = {i: "NO_SUCH_PARTITION" if i % 3 == 2 else "TOO_LARGE" if i % 7 == 6 else None for i in range(40)}
    wanted = hot | {40: "READONLY", 41: "NOT_FOUND", 42: "NOT_FOUND", 43: "RESERVED"}
    assert {r["id"]: r["error"] for r in checked.collect()} == wanted


def matches(subject, pattern):
    if subject is None:
        return False
    have, want = subject.split("."), pattern.split(".")
    if "*" not in want and ">" not in want:
        return have == want
    if want[-1] == ">":
        have, want = have[: len(want) - 1], want[:-1] if len(have) >= len(want) else [None]
    return len(have) == len(want) and all(w in ("*", h) for h, w in zip(have, want, strict=True))


SUBJECTS = ["a", "a.b", "a.b.c", "a.b.d", "b.b.c", "a.c", "aXb", "a.b.c.d", "b", None] + ["hot.same.beginning"] * 50
PATTERNS = ["a", "a.b", "a.*", "a.>", "*", "*.b.c", ">", "a.b.*", "a.*.c", "a.b.>", "hot.same.*", "none.*", "*.*"]


def test_subjects_that_begin_alike_are_not_dealt_by_it(spark, no_small_tables):
    sent = spark.createDataFrame(list(enumerate(SUBJECTS)), "id long, subject string")
    bound = spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(PATTERNS)], "stream string, pattern string")
    fanned = publish.fan_out(sent, bound)
    assert "Exchange hashpartitioning" not in plan(fanned) and "SortMergeJoin" not in plan(fanned)
    got = sorted((r["id"], r["stream"]) for r in fanned.collect())
    assert got == sorted((i, f"s{j}") for i, s in enumerate(SUBJECTS) for j, p in enumerate(PATTERNS) if matches(s, p))
    assert publish.fan_out(sent, bound.where("false")).collect() == []
    only = publish.fan_out(sent, bound.where("stream = 's1'"))  # no wildcard at all
    assert [(r["id"], r["stream"]) for r in only.collect()] == [(1, "s1")]


def test_first_acks_sort_no_fanned_rows_before_they_are_dealt(spark, no_small_tables):
    rows = [(i % 11, f"s{i % 3}", i * 7 % 5) for i in range(200)] + [(None, "s0", 3), (None, "s1", 3), (99, "s2", None)]
    acked = publish.first_acks(spark.createDataFrame(rows, "id long, stream string, at long"), "id", "at")
    lines = plan(acked).splitlines()
    dealt = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x)
    assert not any("Aggregate" in x or "Sort" in x for x in lines[dealt:])
    wanted = {}
    for key, stream, at in rows:
        if at is not None and (key not in wanted or (at, stream) < wanted[key]):
            wanted[key] = (at, stream)
    assert {r["id"]: (r["at"], r["stream"]) for r in acked.where("at is not null").collect()} == wanted


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Op 9 writes many tables; their shuffles stayed on disk until the driver collected its garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))
    before = files()
    counted = spark.range(50_000).withColumn("k", F.col("id") % 999).groupBy("k").agg(F.count("*").alias("n"))
    stored = common.materialize(counted, "counted")
    wait = time.time() + 10
    while files() - before and time.time() < wait:  # they are removed in the background
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == "false" and stored.count() == 999
    common.discard(stored)
