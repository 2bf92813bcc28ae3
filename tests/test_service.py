"""Storage, subscriptions, publishing, catalog and failures by hand-computed cases."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from sparklog import errors, scratch
from sparklog.functions import record, scalar
from sparklog.operators import commit, failover, publish, subscribe
from sparklog.operators import sequence as seq
from sparklog.plans import catalog
from sparklog.sources.events import raw_events, stored_events
from sparklog.sources.stored import StoredLog
from sparklog.streaming import jobs

SF = "/root/testdata/sf0.001"
LOG = "stream string, partition int, ts_us long, key string, value string"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def log(spark):
    return StoredLog(spark, scratch.folder(spark, "test-log"), max_segment_bytes=100, max_segment_us=1000)


def batch(spark, rows):
    return spark.createDataFrame([("s", p, t, None, v) for p, t, v in rows], LOG)


def append(log, df, epoch=0):
    log.append(df, ["ts_us", "value"], F.lit(0), epoch)


def held(df):
    return sorted((r["partition"], r["offset"], r["value"], r["segment"]) for r in df.collect())


def test_appends_go_on_and_roll_once_a_batch(spark, log):
    append(log, batch(spark, [(0, 1, "blah"), (0, 2, "blah"), (0, 3, "blah"), (1, 1, "blah")]))  # 48 bytes each
    append(log, batch(spark, [(0, 4, "blah"), (0, 5, "blah"), (1, 2000, "blah")]), epoch=1)  # full; too old
    append(log, batch(spark, [(0, 6, "blah")]), epoch=1)  # 96 bytes: not full
    assert held(log.scan()) == [(0, 0, "blah", 0), (0, 1, "blah", 0), (0, 2, "blah", 0), (0, 3, "blah", 3), (0, 4, "blah", 3), (0, 5, "blah", 3), (1, 0, "blah", 0), (1, 1, "blah", 1)]
    state = {r["partition"]: (r["next"], r["segment"], r["segment_bytes"], r["leader_epoch"], r["hw"]) for r in log.state().collect()}
    assert state == {0: (6, 3, 144, 1, -1), 1: (2, 1, 48, 1, -1)}
    assert {r["size_bytes"] for r in log.scan().collect()} == {48}


def test_readonly_refuses_appends_but_not_replication(spark, log):
    append(log, batch(spark, [(0, 1, "a"), (1, 1, "a")]))
    log.set_readonly("s", [1])
    with pytest.raises(errors.FailedPrecondition):
        append(log, batch(spark, [(1, 2, "b")]))
    append(log, batch(spark, [(0, 2, "b")]))
    rows = log.scan("s", 1).withColumns({"offset": F.col("offset") + 1, "value": F.lit("c")})
    log.append_sequenced(rows)
    assert [(p, o, v) for p, o, v, _ in held(log.scan())] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c")]


def test_truncated_log_goes_on_from_the_cut(spark, log):
    append(log, batch(spark, [(0, i, f"a{i}") for i in range(4)]))
    append(log, batch(spark, [(0, i, f"a{i}") for i in range(4, 6)]))
    log.commit(spark.createDataFrame([("s", 0, 5)], "stream string, partition int, hw long"))
    log.truncate("s", 0, 3)
    assert [v for _, _, v, _ in held(log.scan())] == ["a0", "a1", "a2"]
    assert log.state().first()["hw"] == 2
    append(log, batch(spark, [(0, 9, "b")]))
    assert [(o, v) for _, o, v, _ in held(log.scan())] == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b")]


def test_watermarks_never_fall_and_bound_reads(spark, log):
    append(log, batch(spark, [(0, i, f"a{i}") for i in range(10)]))
    marks = lambda hw: spark.createDataFrame([("s", 0, hw)], "stream string, partition int, hw long")
    log.commit(marks(6))
    log.commit(marks(4))
    assert sorted(r["offset"] for r in log.committed("s", 0, 5).collect()) == [5, 6]
    assert sorted(r["offset"] for r in log.committed("s", 0, -3, 2).collect()) == [0, 1, 2]
    log.commit(marks(8))
    assert sorted(r["offset"] for r in log.committed("s", 0, 5).collect()) == [5, 6, 7, 8]


def test_a_stored_range_is_one_pruned_scan(spark):
    text = plan(stored_events(spark, SF).committed("events", 2, 50, 120))
    assert text.count("Scan parquet") == 2  # in the tree and in the details
    assert "Exchange" not in text and "PartitionFilters" in text
    pushed = next(x for x in text.splitlines() if x.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(offset,50)" in pushed and "LessThanOrEqual(offset,120)" in pushed


@pytest.fixture(scope="module")
def ten(spark):
    """Ten records, ten microseconds apart, and an empty partition."""
    rows = spark.createDataFrame([("s", 0, i, 10 * i) for i in range(10)], "stream string, partition int, offset long, ts_us long")
    known = spark.createDataFrame([("s", 0), ("s", 1)], "stream string, partition int")
    marks = spark.createDataFrame([("s", 0, 7)], "stream string, partition int, hw long")
    return rows, known, marks


@pytest.mark.parametrize(
    ("spec", "wanted"),
    [
        ({"start_position": "OFFSET", "start_offset": 3, "stop_position": "OFFSET", "stop_offset": 5}, [3, 4, 5]),
        ({"start_position": "OFFSET", "start_offset": -1}, list(range(8))),
        ({"start_position": "TIMESTAMP", "start_us": 25, "stop_position": "TIMESTAMP", "stop_us": 49}, [3, 4]),
        ({"start_position": "TIMESTAMP", "start_us": 1000}, []),
        ({"start_position": "LATEST"}, []),  # newest is not committed; the start is taken back to 8
        ({"start_position": "LATEST", "reverse": True}, list(range(8))),
        ({"start_position": "OFFSET", "start_offset": 5, "stop_position": "OFFSET", "stop_offset": 3, "reverse": True}, [3, 4, 5]),
        ({"partition": 1, "start_position": "EARLIEST"}, []),
    ],
)
def test_subscriptions(spark, ten, spec, wanted):
    rows, known, marks = ten
    found = subscribe.subscribe(rows, subscribe.Spec(**({"stream": "s", "partition": 0} | spec)), known, marks)
    assert sorted(r["offset"] for r in found.collect()) == wanted


@pytest.mark.parametrize(
    ("spec", "error"),
    [
        ({"start_position": "OFFSET", "start_offset": 5, "stop_position": "OFFSET", "stop_offset": 3}, errors.InvalidArgument),
        ({"start_position": "EARLIEST", "stop_position": "TIMESTAMP", "stop_us": -1}, errors.InvalidArgument),
        ({"partition": 1, "start_position": "EARLIEST", "stop_position": "LATEST"}, errors.ResourceExhausted),
        ({"partition": 2}, errors.NotFound),
        ({"start_position": "WHEREVER"}, errors.InvalidArgument),
    ],
)
def test_refused_subscriptions(spark, ten, spec, error):
    rows, known, marks = ten
    with pytest.raises(error):
        subscribe.subscribe(rows, subscribe.Spec(**({"stream": "s", "partition": 0} | spec)), known, marks)


def test_the_newest_member_of_the_greatest_epoch_holds_a_partition(spark):
    rows = [("g", "s", 0, "a", 1, 1), ("g", "s", 0, "b", 3, 2), ("g", "s", 0, "c", 2, 3), ("g", "s", 0, "d", 3, 4)]
    consumers = spark.createDataFrame(rows, "group string, stream string, partition int, consumer string, group_epoch long, seq long")
    assert subscribe.exclusive(consumers).first()["consumer"] == "d"


@pytest.mark.parametrize(("factor", "refused"), [(0, True), (-2, True), (4, True), (3, False), (-1, False)])
def test_replication_factors(spark, factor, refused):
    brokers = spark.createDataFrame([(i, i, 3 - i) for i in range(3)], "id long, position long, load long")
    if refused:
        with pytest.raises(errors.InvalidArgument):
            commit.choose_replicas(brokers, factor)
    else:
        assert [r["id"] for r in commit.choose_replicas(brokers, factor).orderBy("rank").collect()] == [2, 1, 0]


def test_watermark_keeps_what_was_committed(spark):
    replicas = spark.createDataFrame([("s", 0, 8), ("s", 0, 5), ("s", 1, 9), ("s", 2, 3), ("s", 2, 4)], "stream string, partition int, latest long")
    old = spark.createDataFrame([("s", 0, 6), ("s", 1, 4)], "stream string, partition int, hw long")
    got = {r["partition"]: (r["isr"], r["hw"]) for r in commit.high_watermark(replicas, 2, old=old).collect()}
    assert got == {0: (2, 6), 1: (1, 4), 2: (2, 3)}
    assert {r["partition"]: r["hw"] for r in commit.high_watermark(replicas, 2).collect()} == {0: 5, 1: -1, 2: 3}


def test_segments_roll_by_age(spark):
    times = [0, 10, 99, 100, 150, 300, 301]
    rows = spark.createDataFrame([("s", 0, i, t, 1) for i, t in enumerate(times)], "stream string, partition int, offset long, ts_us long, size_bytes long")
    got = {r["offset"]: r["segment"] for r in seq.roll_segments(rows, 1000, max_age_us=100).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}


@pytest.mark.parametrize(("data", "crc"), [(b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (b"", 0), (None, None)])
def test_crc32c_of_known_data(spark, data, crc):
    rows = spark.createDataFrame([(data,), (b"another, longer row" * 50,)], "x binary").coalesce(1)
    assert rows.select("x", record.crc32c(F.col("x")).alias("crc")).where(F.col("x").eqNullSafe(F.lit(data))).first()["crc"] == crc


def test_record_round_trip(spark):
    rows = [(None, b"blah", None), (b"", None, {}), (b"k", b"v", {"b": b"2", "a": b""})]
    df = spark.createDataFrame(rows, "key binary, value binary, headers map<string,binary>")
    body = df.select("*", record.body(F.col("key"), F.col("value"), F.col("headers")).alias("body"), record.record_size(headers="headers").alias("size"))
    fields = record.fields(F.col("body"))
    got = body.select("body", "size", fields["key"].alias("k"), fields["value"].alias("v"), fields["n_headers"].alias("h")).collect()
    as_bytes = lambda x: None if x is None else bytes(x)
    assert [(as_bytes(r["k"]), as_bytes(r["v"]), r["h"]) for r in got] == [(k, v, len(h or {})) for k, v, h in rows]
    assert [r["size"] for r in got] == [48, 44, 46 + 7 + 8]
    assert [len(r["body"]) + 32 for r in got] == [r["size"] for r in got]


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(scalar.tick(F.lit(e), 10)) for e in (3, 10, 11)] == [7, 0, 10]
    waits, w = [], 0
    for _ in range(6):
        w = value(scalar.backoff(F.lit(w)))
        waits.append(w)
    assert waits == [1, 2, 4, 8, 10, 10]
    assert value(scalar.override(F.lit(0), 5)) == 0 and value(scalar.override(F.lit(None).cast("int"), 5)) == 5
    assert value(scalar.server_list(F.lit(" a, ,b ,"))) == ["a", "b"]
    assert value(scalar.retention_text(F.lit(0), F.lit(0), F.lit(0), F.lit(True))) == "[no limits, Compact: true]"


def test_publishing_in_order_of_checks(spark):
    streams = spark.createDataFrame([("s", 2, False, False), ("o", 1, False, True), ("r", 1, True, False)], "stream string, partitions int, readonly boolean, occ boolean")
    rows = [
        (0, "s", 0, b"x", "LEADER", None), (1, "s", 0, b"xx", "LEADER", None), (2, "s", 5, b"x", "LEADER", None), (3, "s", 0, b"x", "NONE", None),
        (4, "o", 0, b"x", "ALL", 0), (5, "o", 0, b"x", "ALL", 0), (6, "o", 0, b"x", "ALL", 1), (7, "o", 0, b"x", "NONE", -1), (8, "r", 0, b"x", "ALL", None), (9, "__cursors", 0, b"x", "ALL", None), (10, "t", 0, b"x", "ALL", None),
    ]
    messages = spark.createDataFrame([(*r, "me") for r in rows], "correlation_id long, stream string, partition int, value binary, ack_policy string, expected_offset long, ack_inbox string")
    done = publish.publish(messages, streams, "correlation_id", F.lit(0), max_bytes=1)
    got = {r["correlation_id"]: r["error"] or r["offset"] for r in done.collect()}
    assert got == {0: 0, 1: "TOO_LARGE", 2: "NO_SUCH_PARTITION", 3: 1, 4: 0, 5: "INCORRECT_OFFSET", 6: 1, 7: "OCC_NEEDS_ACK", 8: "READONLY", 9: "RESERVED", 10: "NOT_FOUND"}
    assert sorted(r["correlation_id"] for r in publish.acks(done).collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def ops(spark, rows):
    full = [(i, op, "a", n, partitions, flag) for i, (op, n, partitions, flag) in enumerate(rows)]
    return spark.createDataFrame(full, "index long, op string, name string, n int, partitions array<int>, flag boolean")


def test_catalog_preconditions_and_state(spark):
    rows = [("pause_stream", None, [], None), ("create_stream", 2, None, None), ("create_stream", 9, None, None), ("pause_stream", None, [1], None), ("pause_stream", None, [2], None), ("set_readonly", None, [], True)]
    done = {r["index"]: r["error"] for r in catalog.apply(ops(spark, rows)).collect()}
    assert done == {0: "NOT_FOUND", 1: None, 2: "ALREADY_EXISTS", 3: None, 4: "NO_SUCH_PARTITION", 5: None}
    state = lambda rows: sorted((r["partition"], r["epoch"], r["paused"], r["readonly"]) for r in catalog.fold_partitions(ops(spark, rows)).collect())
    assert state(rows) == [(0, 1, False, True), (1, 1, True, True)]
    again = [*rows, ("resume_stream", None, [1], None), ("set_readonly", None, [0], False)]
    assert state(again) == [(0, 1, False, False), (1, 1, False, True)]
    anew = [*again, ("delete_stream", None, None, None), ("delete_stream", None, None, None), ("create_stream", 1, None, None)]
    assert state(anew) == [(0, 10, False, False)]
    assert state([*rows, ("delete_stream", None, None, None)]) == []


def test_isr_operations_are_fenced_by_epoch(spark):
    rows = [(1, 5, "shrink_isr", 2), (2, 4, "expand_isr", 2), (3, 5, "change_leader", 1), (4, 6, "change_leader", 1), (5, 7, "shrink_isr", 0), (6, 8, "expand_isr", 0)]
    moves = spark.createDataFrame([(0, *r) for r in rows], "partition int, index long, epoch long, op string, replica long")
    replicas = spark.createDataFrame([(0, [0, 1, 2], 0), (1, [0, 1], 1)], "partition int, replicas array<long>, leader long")
    got = {r["partition"]: (r["isr"], r["leader"]) for r in catalog.fold_isr(moves, replicas, ["partition"]).collect()}
    assert got == {0: ([0, 1], 1), 1: ([0, 1], 1)}


def test_reports_time_out_between_rounds(spark):
    day = 86_400_000_000
    times = [(0, 1), (5, 2), (9, 2), (30, 1), (day - 1, 1), (day + 3, 2), (day + 8, 3)]
    reports = spark.createDataFrame([("p", t, w) for t, w in times], "p string, ts_us long, witness long")
    got = sorted((r["first_us"], r["last_us"], r["witnesses"]) for r in failover.rounds(reports, ["p"], failover.leader_failover(10)).collect())
    assert got == [(0, 9, 2), (30, 30, 1), (day - 1, day + 8, 3)]
    members = spark.createDataFrame([("p", 5)], "p string, members int")
    found = failover.elect(failover.rounds(reports, ["p"], failover.leader_failover(10)), members, ["p"], failover.leader_failover(10))
    assert [r["first_us"] for r in found.collect()] == [day - 1]


def test_attempts_over_micro_batches(spark, tmp_path):
    tries = [(0, 0), (1, 0), (2, 1), (3, -1), (4, 3), (5, 2), (6, 4)]
    for part in (tries[:3], tries[3:5], tries[5:]):
        spark.createDataFrame([(0, n, e) for n, e in part], "p int, n long, expected long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("p int, n long, expected long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.accept_stream(stream, f"file://{tmp_path}", "p", "n").orderBy("n").collect()
    assert [r["offset"] for r in got] == [0, None, 1, 2, 3, None, 4]


def test_quiet_members_over_micro_batches(spark, tmp_path):
    for part in ([("a", 0), ("b", 1)], [("a", 5), ("b", 30)], [("a", 60)]):
        rows = spark.createDataFrame(part, "m string, s long").selectExpr("m", "timestamp_seconds(s) AS time")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("m string, time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.quiet_since(stream, ["m"], "time", "10 seconds"), f"file://{tmp_path}", "quiet")
    assert sorted((r["m"], r["f"], r["l"]) for r in got.selectExpr("m", "unix_seconds(first) f", "unix_seconds(last) l").collect()) == [("a", 0, 5), ("b", 1, 1), ("b", 30, 30)]


def test_handlers_see_every_batch(spark, tmp_path):
    for i in range(2):
        spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.each_batch(stream, f"file://{tmp_path}", lambda df, n: seen.append((n, [r["id"] for r in df.collect()])))
    assert [n for n, _ in seen] == [0, 1] and sorted(x for _, ids in seen for x in ids) == [0, 1]


def test_fan_out_of_patterns(spark):
    messages = spark.createDataFrame([(1, "a.b.c"), (2, "a.b"), (3, "a"), (4, "x.b.c")], "id long, subject string")
    bindings = spark.createDataFrame([("lit", "a.b"), ("tail", "a.>"), ("star", "a.*"), ("mid", "a.*.c"), ("any", ">"), ("head", "*.b.c")], "stream string, pattern string")
    got = {}
    for r in publish.fan_out(messages, bindings).collect():
        got.setdefault(r["stream"], set()).add(r["id"])
    assert got == {"lit": {2}, "tail": {1, 2}, "star": {2}, "mid": {1}, "any": {1, 2, 3, 4}, "head": {1, 4}}


def test_events_are_appended_once_in_a_session(spark):
    assert stored_events(spark, SF).path == stored_events(spark, SF).path
    assert stored_events(spark, SF).scan().count() == raw_events(spark, SF).count()
