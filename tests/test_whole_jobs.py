"""Queries over all rows, at a scale at which a cut would show."""

from __future__ import annotations

import pytest
from compare import assert_same
from pyspark.sql import functions as F
from sparklog import queries
from sparklog.operators import commit

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["occ_accept_all", "cursor_latest_all", "cursor_missing_default_all", "group_assign_all_members"])
def test_all_rows_match_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_occ_accept_all_answers_every_event(spark):
    assert queries.QUERIES["occ_accept_all"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_assignment_deals_as_the_group_does(spark):
    ids = [f"m{i}" for i in range(9)]
    group = commit.Group({"foo": 7, "bar": 20})
    rows = [("foo", m) for m in ids] + [("bar", f"x{m}") for m in ids[:6]]
    for stream, m in reversed(rows):
        group.join(m, [stream])
    wanted = {(s, p, m) for m, held in group.assigned.items() for s, ps in held.items() for p in ps}
    members = spark.createDataFrame(rows + rows[:2], "stream string, member string")
    streams = spark.createDataFrame([("foo", 7), ("bar", 20), ("empty", 0), ("alone", 3)], "stream string, partitions long")
    assert [tuple(r) for r in commit.assign_partitions(members, streams).orderBy("stream", "partition").collect()] == sorted(wanted)


def test_group_fold_is_the_fold_of_every_group(spark):
    talk = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("turn", "conv_id").select("conv_id", "turn").collect()
    groups = {}
    for c, turn in talk:
        group = groups.setdefault(c // 20, commit.Group({"foo": 12, "bar": 5}))
        if turn % 3 == 2:
            if f"c{c}" in group.members:
                group.leave(f"c{c}")
        elif f"c{c}" not in group.members:
            group.join(f"c{c}", ["foo"] if c % 2 else ["foo", "bar"])
    wanted = {(g, s, p, m) for g, x in groups.items() for m, held in x.assigned.items() for s, ps in held.items() for p in ps}
    got = queries.QUERIES["group_assign_fold"](spark, SF).select(F.col("group"), "stream", "partition", "member").collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
