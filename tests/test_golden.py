"""Hand-computed logs."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F
from sparklog.functions import scalar
from sparklog.operators import commit, compact, scan
from sparklog.operators import sequence as seq


@pytest.fixture(scope="module")
def numbered(spark):
    """Ten records, ten microseconds apart, stamped from 0."""
    return spark.createDataFrame([("s", 0, i, 10 * i, f"k{i}") for i in range(10)], "stream string, partition int, offset long, ts_us long, key string")


def offsets(df):
    return sorted(r["offset"] for r in df.collect())


KEYS = ["foo", "bar", "foo", "foo", "bar", "baz", "baz", "qux", "foo", "baz"]


def keyed(spark, keys, hw, per_segment=2):
    rows = [("s", 0, i, k, i // per_segment * per_segment, hw) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "stream string, partition int, offset long, key string, segment long, hw long")


@pytest.mark.parametrize(("hw", "stay"), [(9, [4, 7, 8, 9]), (5, [3, 4, 5, 6, 7, 8, 9])])
def test_compaction(spark, hw, stay):
    assert offsets(compact.compact(keyed(spark, KEYS, hw))) == stay


def test_compaction_keeps_null_keys_and_one_segment(spark):
    assert offsets(compact.compact(keyed(spark, [None] * 4, 3, 1))) == [0, 1, 2, 3]
    assert offsets(compact.compact(keyed(spark, ["a"] * 4, 3, 10))) == [0, 1, 2, 3]


def test_compaction_twice_is_once(spark):
    once = compact.compact(keyed(spark, KEYS, 9))
    assert offsets(compact.compact(once)) == offsets(once)


def segments(spark, rows):
    return spark.createDataFrame([("s", 0, *r) for r in rows], "stream string, partition int, segment long, records long, bytes long, last_write long")


def bases(df):
    return sorted(r["segment"] for r in df.collect())


def test_retention(spark):
    five = segments(spark, [(i, 1, 48, 10 * i) for i in range(5)])
    twenty = segments(spark, [(i, 1, 48, 10 * i) for i in range(20)])
    assert bases(compact.retain_count(five, 100, "bytes")) == [3, 4]
    assert bases(compact.retain_count(twenty, 10)) == list(range(10, 20))
    assert bases(compact.retain_count(segments(spark, [(0, 10, 1, 0), (10, 10, 1, 0)]), 5)) == [10]
    assert bases(compact.retain_count(compact.retain_count(twenty, 15), 240, "bytes")) == list(range(15, 20))
    assert bases(compact.retain_age(twenty, 100)) == list(range(10, 20))


def test_age_retention_stops_at_the_first_survivor(spark):
    assert bases(compact.retain_age(segments(spark, [(0, 1, 1, 5), (1, 1, 1, 50), (2, 1, 1, 5), (3, 1, 1, 60)]), 20)) == [1, 2, 3]


@pytest.mark.parametrize(("t", "start"), [(-1, 0), (20, 2), (25, 3), (30, 3), (90, 9), (500, 10)])
def test_earliest_offset(numbered, t, start):
    assert numbered.agg(scan.start_at(t).alias("o")).first()["o"] == start


@pytest.mark.parametrize(("t", "stop"), [(-1, None), (5, 0), (20, 2), (25, 2), (30, 3), (90, 9), (500, 9)])
def test_latest_offset(numbered, t, stop):
    assert numbered.agg(scan.stop_at(t).alias("o")).first()["o"] == stop


def test_earliest_offset_of_an_empty_log(numbered):
    assert numbered.where("false").agg(scan.start_at(100).alias("o")).first()["o"] == 0


def test_scans(numbered):
    assert offsets(scan.forward(numbered, -3, 4)) == [0, 1, 2, 3, 4]
    assert offsets(scan.forward(numbered, 2, 8, 5)) == [2, 3, 4, 5]
    assert offsets(scan.reverse(numbered, 9, 7)) == list(range(8))
    assert offsets(scan.reverse(numbered, 9, stop=5)) == [5, 6, 7, 8, 9]


@pytest.fixture(scope="module")
def epochs(spark):
    return spark.createDataFrame([("s", 0, i, 1 + i // 5) for i in range(15)], "stream string, partition int, offset long, leader_epoch long")


def last_offsets(spark, log, asked):
    found = seq.last_offset_for_epoch(log, spark.createDataFrame([(e,) for e in asked], "asked long"))
    return {r["asked"]: r["last_offset"] for r in found.collect()}


def test_epochs(spark, epochs):
    assert last_offsets(spark, epochs, [0, 1, 2, 3]) == {0: 0, 1: 5, 2: 10, 3: 14}
    assert last_offsets(spark, epochs.where("offset < 7"), [0, 1]) == {0: 0, 1: 5}
    assert last_offsets(spark, epochs.where("offset >= 10"), [0, 1, 2, 3]) == {0: 10, 1: 10, 2: 10, 3: 14}
    assert last_offsets(spark, epochs.where("offset in (4, 9, 14)"), [0, 1, 2, 3]) == {0: 4, 1: 9, 2: 14, 3: 14}


def test_watermark_needs_enough_replicas(spark):
    isr = spark.createDataFrame([("s", 0, 3), ("s", 1, 4), ("s", 1, 2)], "stream string, partition int, latest long")
    assert {r["partition"]: r["hw"] for r in commit.high_watermark(isr, 2).collect()} == {0: -1, 1: 2}


def test_sequencing_is_dense_whatever_the_buckets(spark):
    rows = [("s", i % 3, i // 7, i) for i in range(200)]
    log = spark.createDataFrame(rows, "stream string, partition int, day long, n long")
    out = seq.sequence(log, ["stream", "partition"], ["day", "n"], F.col("day"), base=5).orderBy("partition", "n").collect()
    for p in range(3):
        assert [r["offset"] for r in out if r["partition"] == p] == list(range(5, 5 + sum(r[1] == p for r in rows)))


def test_optimistic_concurrency(spark):
    tries = spark.createDataFrame([("s", 0, i, e) for i, e in enumerate([0, 0, 1, -1, 2, 3])], "stream string, partition int, n long, expected long")
    out = {r["n"]: (r["accepted"], r["offset"]) for r in seq.accept_expected(tries, ["stream", "partition"], "n").collect()}
    assert out == {0: (True, 0), 1: (False, None), 2: (True, 1), 3: (True, 2), 4: (False, None), 5: (True, 3)}


def test_group_lifecycle():
    group = commit.Group({"foo": 2, "bar": 2})
    group.join("cons1", ["foo", "bar"])
    assert group.assigned == {"cons1": {"bar": [0, 1], "foo": [0, 1]}}
    group.join("cons2", ["foo"])
    assert group.assigned == {"cons1": {"bar": [0, 1], "foo": []}, "cons2": {"foo": [0, 1]}}
    group.leave("cons2")
    assert group.assigned == {"cons1": {"bar": [0, 1], "foo": [0, 1]}}
    with pytest.raises(ValueError, match="member already"):
        group.join("cons1", ["foo"])
    with pytest.raises(ValueError, match="unknown"):
        group.join("cons3", ["nowhere"])


@pytest.mark.parametrize(("factor", "chosen"), [(-1, "cba"), (1, "c"), (2, "cb"), (3, "cba")])
def test_replica_placement(spark, factor, chosen):
    brokers = spark.createDataFrame([("a", 0, 6), ("b", 1, 3), ("c", 2, 1)], "id string, position int, load long")
    ranked = commit.choose_replicas(brokers, factor).orderBy("rank").collect()
    assert "".join(r["id"] for r in ranked) == chosen


def test_cursor_is_the_latest(spark):
    cursors = spark.createDataFrame([("c", 0, 0, 5), ("c", 0, 1, 10)], "cursor_id string, partition int, log_offset long, cursor_offset long")
    assert commit.latest_cursors(cursors, ["cursor_id", "partition"]).first()["cursor_offset"] == 10


@pytest.mark.parametrize("n", [0, 1, 5])
@pytest.mark.parametrize("key", ["", "foo", None, "Ünï"])
def test_key_partition(spark, key, n):
    got = spark.range(1).select(scalar.key_partition(F.lit(key).cast("string"), n).alias("p")).first()["p"]
    assert got == (zlib.crc32((key or "").encode()) % n if n else 0)


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(scalar.partition_subject(F.lit("foo"), F.lit(0))) == "foo"
    assert value(scalar.partition_subject(F.lit("foo"), F.lit(2))) == "foo.2"
    assert value(scalar.cursor_key(F.lit("c"), F.lit("s"), F.lit(3))) == "c,s,3"
    assert value(scalar.segment_file(F.lit(42))) == f"{42:020d}.log"
    assert [value(scalar.valid_subject(F.lit(s))) for s in ("a.b", "a b", "a..b", ".a", "")] == [True, False, False, False, False]
    match = lambda s, p: value(scalar.subject_matches(F.lit(s), F.lit(p)))
    assert match("foo.bar", "foo.*") and match("foo.bar.baz", "foo.>") and not match("foo.bar.baz", "foo.*") and not match("fooxbar", "foo.bar")


def test_envelope_round_trip(spark):
    data = spark.range(1).select(scalar.envelope(F.lit("hello")).alias("e"))
    assert data.select(scalar.envelope_value(F.col("e")).cast("string").alias("v")).first()["v"] == "hello"
    raw = spark.range(1).select(scalar.envelope_value(F.lit("plain").cast("binary")).cast("string").alias("v"))
    assert raw.first()["v"] == "plain"
