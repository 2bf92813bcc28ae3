"""Sequencing over several batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from sparklog import queries
from sparklog.streaming.sequencing import drain_sequenced

DAY = 86_400_000_000
SCHEMA = "partition int, ts_us long, event_id long"


def test_offsets_go_on_from_batch_to_batch(spark, tmp_path):
    wanted, following = set(), {}
    for b in range(3):
        rows = [((None, 0, 1)[i % 3] if b else i % 2, b * 10 * DAY + (i * 7 % 40) * DAY // 5, 100 * b + i) for i in range(60)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for p, _, e in sorted(rows, key=lambda r: r[1:]):
            wanted.add((p, e, following.get(p, 0)))
            following[p] = following.get(p, 0) + 1
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain_sequenced(stream, f"file://{tmp_path}").select("partition", "event_id", "offset").collect()
    assert len(got) == 180
    assert {tuple(r) for r in got} == wanted


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    out = drain_sequenced(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), f"file://{tmp_path}")
    assert out.count() == 0 and out.columns == ["partition", "ts_us", "event_id", "offset"]


def test_events_are_in_files_and_not_in_the_driver(spark):
    out = queries.QUERIES["stream_sequence_available_now"](spark, "/root/testdata/sf0.001")
    assert out.inputFiles() and out.agg(F.count("*")).first()[0] == 1000
