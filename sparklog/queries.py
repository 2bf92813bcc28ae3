"""The log's queries by name, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog import scratch
from sparklog.functions import record, scalar
from sparklog.operators import commit, compact, publish, quantiles, scan
from sparklog.operators import sequence as seq
from sparklog.plans import catalog
from sparklog.schema import RESERVED_STREAMS
from sparklog.sources.events import events_log, raw_events, stored_events, table
from sparklog.streaming.sequencing import drain_sequenced

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The same log in SQL.
LOG = """WITH log AS (
  SELECT 'events' AS stream, CAST(user_id % 4 AS INTEGER) AS partition,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS "offset",
         epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS key, props AS value, event_type, user_id, event_id
  FROM events
), sized AS (
  SELECT *, CAST(44 + coalesce(strlen(key), 0) + coalesce(strlen(value), 0) AS BIGINT) AS size_bytes,
         CAST(floor("offset" / 100) * 100 AS BIGINT) AS segment, CAST(floor(ts_us / 86400000000) AS BIGINT) AS leader_epoch
  FROM log
), st AS (SELECT stream, partition, max("offset") - 10 AS hw FROM log GROUP BY ALL)
"""
SEGMENTS = """, seg AS (
  SELECT stream, partition, segment, count(*) AS records, CAST(sum(size_bytes) AS BIGINT) AS bytes, min("offset") AS first_offset,
         max("offset") AS last_offset, arg_min(ts_us, "offset") AS first_write, arg_max(ts_us, "offset") AS last_write
  FROM sized GROUP BY ALL
)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def sized_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events log with sizes, segments of a hundred records and daily leader epochs."""
    return events_log(spark, sf_dir).withColumns(
        {
            "size_bytes": record.record_size(),
            "segment": (F.floor(F.col("offset") / 100) * 100).cast("long"),
            "leader_epoch": F.floor(F.col("ts_us") / 86_400_000_000).cast("long"),
        }
    )


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return scan.with_watermark(log, scan.high_watermarks(log, 10))


DELIVERED = ["partition", "offset", "ts_us", "key", "value"]
DELIVERED_SQL = 'partition, "offset", ts_us, key, value'


@query("log_sequence", LOG + f"SELECT {DELIVERED_SQL} FROM log")
def log_sequence(spark, sf_dir):
    return events_log(spark, sf_dir).select(*DELIVERED)


@query("scan_committed_range", LOG + f'SELECT {DELIVERED_SQL} FROM log JOIN st USING (stream, partition) WHERE partition = 2 AND "offset" BETWEEN 50 AND 5000 AND "offset" <= hw')
def scan_committed_range(spark, sf_dir):
    return stored_events(spark, sf_dir).committed("events", 2, 50, 5000).select(*DELIVERED)


@query("scan_uncommitted", LOG + f'SELECT {DELIVERED_SQL} FROM log WHERE partition = 1 AND "offset" >= 100')
def scan_uncommitted(spark, sf_dir):
    return scan.forward(stored_events(spark, sf_dir).scan("events", 1), 100).select(*DELIVERED)


@query("scan_reverse_limit", LOG + """SELECT partition, "offset", row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) AS rank, key
FROM log JOIN st USING (stream, partition) WHERE "offset" <= hw AND "offset" > hw - 20""")  # fmt: skip
def scan_reverse_limit(spark, sf_dir):
    log = positioned(spark, sf_dir)
    newest = scan.reverse(log, F.col("hw")).where("offset > hw - 20")
    rank = F.row_number().over(Window.partitionBy("partition").orderBy(F.desc("offset"))).cast("long")
    return newest.select("partition", "offset", rank.alias("rank"), "key")


TIMES = [0, 1704067200000000, 1704672000000000, 1705276800000000, 4102444800000000]
_TIMES_SQL = ", ".join(f"({t})" for t in TIMES)


def _asked(log: DataFrame) -> DataFrame:
    """Every time for every partition."""
    return log.select("stream", "partition").distinct().withColumn("t", F.explode(F.array(*(F.lit(t).cast("long") for t in TIMES))))


@query("start_at_timestamp", LOG + f"""SELECT partition, t, coalesce(min("offset") FILTER (ts_us >= t), max("offset") + 1, 0) AS start_offset
FROM log, (VALUES {_TIMES_SQL}) v(t) GROUP BY ALL""")  # fmt: skip
def start_at_timestamp(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return scan.starts_at(log, _asked(log)).select("partition", "t", "start_offset")


@query("stop_at_timestamp", LOG + f"""SELECT partition, t, max("offset") FILTER (ts_us <= t) AS stop_offset
FROM log, (VALUES {_TIMES_SQL}) v(t) GROUP BY ALL""")  # fmt: skip
def stop_at_timestamp(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return scan.stops_at(log, _asked(log)).select("partition", "t", "stop_offset")


@query("start_positions_all", LOG + 'SELECT partition, min("offset") AS earliest, max("offset") AS latest, max("offset") + 1 AS new_only, greatest(-5, 0)::BIGINT AS negative FROM log GROUP BY ALL')
def start_positions_all(spark, sf_dir):
    b = scan.bounds(events_log(spark, sf_dir))
    return b.select("partition", F.col("oldest").alias("earliest"), F.col("newest").alias("latest"), (F.col("newest") + 1).alias("new_only"), F.greatest(F.lit(-5), F.lit(0)).cast("long").alias("negative"))


@query("stop_positions_all", LOG + 'SELECT partition, max("offset") AS latest, least(max("offset"), 1000) AS at_offset, max(hw) AS committed FROM log JOIN st USING (stream, partition) GROUP BY ALL')
def stop_positions_all(spark, sf_dir):
    return positioned(spark, sf_dir).groupBy("partition").agg(F.max("offset").alias("latest"), F.least(F.max("offset"), F.lit(1000).cast("long")).alias("at_offset"), F.max("hw").alias("committed"))


@query("partition_bounds", LOG + 'SELECT partition, min("offset") AS oldest, max("offset") AS newest, min(ts_us) AS first_ts, max(ts_us) AS last_ts, count(*) AS records FROM log GROUP BY ALL')
def partition_bounds(spark, sf_dir):
    return scan.bounds(events_log(spark, sf_dir)).drop("stream")


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


@query("partition_by_key_crc32", f"""WITH k AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events), t AS (SELECT {_crc_table()} AS crc)
SELECT key, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
       lambda a, b: xor(crc[(xor(a, b) & 255) + 1]::BIGINT, a >> 8)), 4294967295::BIGINT) % 5 AS INTEGER) AS target FROM k, t""")  # fmt: skip
def partition_by_key_crc32(spark, sf_dir):
    keys = raw_events(spark, sf_dir).select("key").distinct()
    return keys.select("key", scalar.key_partition(F.col("key"), 5).alias("target"))


@query("partition_round_robin", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 AS target FROM orders")
def partition_round_robin(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).alias("all"))
    numbered = seq.sequence(orders, ["all"], ["o_orderkey"], bucket=F.floor(F.col("o_orderkey") / 10_000))
    return numbered.select("o_orderkey", (F.col("offset") % 3).alias("target"))


@query("compact_latest_per_key", LOG + 'SELECT partition, key, max("offset") AS "offset", arg_max(value, "offset") AS value FROM log GROUP BY partition, key')
def compact_latest_per_key(spark, sf_dir):
    return compact.latest_by_key(events_log(spark, sf_dir)).select("partition", "key", "offset", "value")


_COMPACT = """, x AS (
  SELECT partition, "offset", segment, hw, {key} AS key FROM sized JOIN st USING (stream, partition)
), y AS (
  SELECT *, max(CASE WHEN "offset" <= hw THEN "offset" END) OVER (PARTITION BY partition, key) AS newest, max(segment) OVER (PARTITION BY partition) AS active FROM x
) SELECT partition, "offset", key FROM y WHERE key IS NULL OR "offset" = newest OR "offset" >= hw OR segment = active"""


@query("compact_with_hw", LOG + _COMPACT.format(key="key"))
def compact_with_hw(spark, sf_dir):
    log = sized_log(spark, sf_dir)
    log = scan.with_watermark(log, scan.high_watermarks(log, 10))
    return compact.compact(log).select("partition", "offset", "key")


@query("compact_null_keys", LOG + _COMPACT.format(key="CASE WHEN event_type = 'error' THEN NULL ELSE key END"))
def compact_null_keys(spark, sf_dir):
    log = sized_log(spark, sf_dir).withColumn("key", F.when(F.col("event_type") != "error", F.col("key")))
    log = scan.with_watermark(log, scan.high_watermarks(log, 10))
    return compact.compact(log).select("partition", "offset", "key")


@query("segment_roll_bytes", LOG.replace("WITH log", "WITH RECURSIVE log") + """, f AS (
  SELECT partition, "offset", size_bytes, 0::BIGINT AS segment, size_bytes AS held FROM sized WHERE "offset" = 0
  UNION ALL
  SELECT s.partition, s."offset", s.size_bytes, CASE WHEN held >= 10000 THEN s."offset" ELSE f.segment END,
         CASE WHEN held >= 10000 THEN s.size_bytes ELSE held + s.size_bytes END
  FROM f JOIN sized s ON s.partition = f.partition AND s."offset" = f."offset" + 1
) SELECT partition, "offset", segment FROM f""")  # fmt: skip
def segment_roll_bytes(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("size_bytes", record.record_size())
    return seq.roll_segments(log, 10_000).select("partition", "offset", "segment")


@query("segment_stats", LOG + SEGMENTS + " SELECT * EXCLUDE (stream) FROM seg")
def segment_stats(spark, sf_dir):
    return compact.segment_stats(sized_log(spark, sf_dir)).drop("stream")


_FIRST = "row_number() OVER (PARTITION BY partition ORDER BY segment DESC)"
_RUN = "sum({m}) OVER (PARTITION BY partition ORDER BY segment DESC ROWS UNBOUNDED PRECEDING)"


@query("retention_messages", LOG + SEGMENTS + f" SELECT partition, segment, records FROM seg QUALIFY {_RUN.format(m='records')} <= 550 OR {_FIRST} = 1")
def retention_messages(spark, sf_dir):
    return compact.retain_count(compact.segment_stats(sized_log(spark, sf_dir)), 550).select("partition", "segment", "records")


@query("retention_bytes", LOG + SEGMENTS + f" SELECT partition, segment, bytes FROM seg QUALIFY {_RUN.format(m='bytes')} <= 40000 OR {_FIRST} = 1")
def retention_bytes(spark, sf_dir):
    return compact.retain_count(compact.segment_stats(sized_log(spark, sf_dir)), 40_000, "bytes").select("partition", "segment", "bytes")


CUTOFF = 1705276800000000


@query("retention_age", LOG + SEGMENTS + f" SELECT partition, segment, last_write FROM seg QUALIFY max(CAST(last_write >= {CUTOFF} AS INTEGER)) OVER (PARTITION BY partition ORDER BY segment ROWS UNBOUNDED PRECEDING) = 1 OR {_FIRST} = 1")
def retention_age(spark, sf_dir):
    return compact.retain_age(compact.segment_stats(sized_log(spark, sf_dir)), CUTOFF).select("partition", "segment", "last_write")


@query("retention_pipeline", LOG + SEGMENTS + f""", a AS (SELECT * FROM seg QUALIFY max(CAST(last_write >= {CUTOFF} AS INTEGER)) OVER (PARTITION BY partition ORDER BY segment ROWS UNBOUNDED PRECEDING) = 1 OR {_FIRST} = 1),
b AS (SELECT * FROM a QUALIFY {_RUN.format(m='records')} <= 1500 OR {_FIRST} = 1)
SELECT partition, segment, records, bytes FROM b QUALIFY {_RUN.format(m='bytes')} <= 90000 OR {_FIRST} = 1""")  # fmt: skip
def retention_pipeline(spark, sf_dir):
    return compact.retain(compact.segment_stats(sized_log(spark, sf_dir)), CUTOFF, 1500, 90_000).select("partition", "segment", "records", "bytes")


@query("replication_batch_bytes", LOG + """, r AS (SELECT partition, "offset", sum(size_bytes) OVER (PARTITION BY partition ORDER BY "offset") AS total FROM sized WHERE "offset" > 20)
SELECT partition, "offset", CAST(total AS BIGINT) AS total FROM r WHERE total <= 20000""")  # fmt: skip
def replication_batch_bytes(spark, sf_dir):
    later = sized_log(spark, sf_dir).where("offset > 20 and offset <= 20 + 20000")  # a record has a byte at least
    running = F.sum("size_bytes").over(Window.partitionBy("partition").orderBy("offset"))
    return later.withColumn("total", running).where("total <= 20000").select("partition", "offset", "total")


@query("epoch_starts", LOG + 'SELECT partition, leader_epoch, min("offset") AS start_offset FROM sized GROUP BY ALL')
def epoch_starts(spark, sf_dir):
    return seq.epoch_starts(sized_log(spark, sf_dir)).drop("stream")


@query("epoch_last_offset", LOG + """, e AS (SELECT partition, leader_epoch, min("offset") AS s FROM sized GROUP BY ALL), n AS (SELECT partition, max("offset") AS newest FROM log GROUP BY ALL),
q AS (SELECT DISTINCT leader_epoch AS asked FROM sized)
SELECT n.partition, asked, coalesce(min(s) FILTER (leader_epoch > asked), any_value(newest)) AS last_offset FROM n JOIN e USING (partition), q GROUP BY n.partition, asked""")  # fmt: skip
def epoch_last_offset(spark, sf_dir):
    log = sized_log(spark, sf_dir)
    return seq.last_offset_for_epoch(log, log.select(F.col("leader_epoch").alias("asked")).distinct()).drop("stream")


@query("truncate_to_epoch", LOG + """, m AS (SELECT partition, min(leader_epoch) + 1 AS e FROM sized GROUP BY ALL),
c AS (SELECT partition, min("offset") AS cut FROM sized JOIN m USING (partition) WHERE leader_epoch > e GROUP BY ALL)
SELECT partition, "offset", leader_epoch FROM sized LEFT JOIN c USING (partition) WHERE cut IS NULL OR "offset" < cut""")  # fmt: skip
def truncate_to_epoch(spark, sf_dir):
    log = sized_log(spark, sf_dir)
    keep = log.groupBy("partition").agg((F.min("leader_epoch") + 1).alias("e"))
    cut = log.join(keep, "partition").where("leader_epoch > e").groupBy("partition").agg(F.min("offset").alias("cut"))
    return log.join(cut, "partition", "left").where("cut is null or offset < cut").select("partition", "offset", "leader_epoch")


@query("high_watermark_isr_min", LOG + """, r AS (SELECT stream, partition, n AS replica, max("offset") - n * partition AS latest FROM log, (VALUES (0), (1), (2)) v(n) WHERE NOT (partition = 3 AND n > 0) GROUP BY stream, partition, n)
SELECT partition, count(*) AS isr, CASE WHEN count(*) >= 2 THEN min(latest) ELSE -1 END AS hw FROM r GROUP BY partition""")  # fmt: skip
def high_watermark_isr_min(spark, sf_dir):
    newest = events_log(spark, sf_dir).groupBy("stream", "partition").agg(F.max("offset").alias("newest"))
    replicas = newest.withColumn("replica", F.explode(F.array(*map(F.lit, range(3))))).where("not (partition = 3 and replica > 0)")
    return commit.high_watermark(replicas.withColumn("latest", F.col("newest") - F.col("replica") * F.col("partition")), 2).drop("stream")


@query("ack_policy_times", LOG + """SELECT partition, "offset", policy, CASE policy WHEN 'LEADER' THEN ts_us WHEN 'ALL' THEN max(ts_us) OVER (PARTITION BY partition, floor("offset" / 50)) END AS ack_us
FROM (SELECT *, CASE "offset" % 3 WHEN 0 THEN 'LEADER' WHEN 1 THEN 'ALL' ELSE 'NONE' END AS policy FROM log)""")  # fmt: skip
def ack_policy_times(spark, sf_dir):
    policy = F.when(F.col("offset") % 3 == 0, "LEADER").when(F.col("offset") % 3 == 1, "ALL").otherwise("NONE")
    log = events_log(spark, sf_dir).withColumns({"policy": policy, "batch": F.floor(F.col("offset") / 50)})
    log = log.withColumn("committed", F.max("ts_us").over(Window.partitionBy("partition", "batch")))
    return log.select("partition", "offset", "policy", commit.ack_time(F.col("policy"), F.col("ts_us"), F.col("committed")).alias("ack_us"))


_CURSORS = """, c AS (SELECT partition, event_type AS cursor_id, "offset" AS log_offset, "offset" - 1 AS cursor_offset FROM log),
latest AS (SELECT partition, cursor_id, arg_max(cursor_offset, log_offset) AS cursor_offset FROM c GROUP BY ALL)"""


def _cursors(log: DataFrame) -> DataFrame:
    set_ = log.select("partition", F.col("event_type").alias("cursor_id"), F.col("offset").alias("log_offset"), (F.col("offset") - 1).alias("cursor_offset"))
    return commit.latest_cursors(set_, ["partition", "cursor_id"])


@query("cursor_latest", LOG + _CURSORS + " SELECT cursor_id || ',events,' || partition AS cursor_key, cursor_offset FROM latest")
def cursor_latest(spark, sf_dir):
    latest = _cursors(events_log(spark, sf_dir))
    return latest.select(scalar.cursor_key(F.col("cursor_id"), F.lit("events"), F.col("partition")).alias("cursor_key"), "cursor_offset")


@query("cursor_missing_default", LOG + _CURSORS + """, asked AS (SELECT partition, cursor_id FROM (SELECT DISTINCT partition FROM log), (VALUES ('click'), ('nobody')) v(cursor_id))
SELECT partition, cursor_id, coalesce(cursor_offset, -1) AS cursor_offset FROM asked LEFT JOIN latest USING (partition, cursor_id)""")  # fmt: skip
def cursor_missing_default(spark, sf_dir):
    log = events_log(spark, sf_dir)
    asked = log.select("partition").distinct().withColumn("cursor_id", F.explode(F.array(F.lit("click"), F.lit("nobody"))))
    return _latest_or_none(asked, log)


def _latest_or_none(asked: DataFrame, log: DataFrame) -> DataFrame:
    return asked.join(_cursors(log), ["partition", "cursor_id"], "left").withColumn("cursor_offset", F.coalesce("cursor_offset", F.lit(-1).cast("long")))


@query("cursor_latest_all", ORACLE_SQL["cursor_latest"])
def cursor_latest_all(spark, sf_dir):
    latest = _cursors(events_log(spark, sf_dir))
    return latest.select(scalar.cursor_key(F.col("cursor_id"), F.lit("events"), F.col("partition")).alias("cursor_key"), "cursor_offset")


@query("cursor_missing_default_all", ORACLE_SQL["cursor_missing_default"])
def cursor_missing_default_all(spark, sf_dir):
    log = events_log(spark, sf_dir)
    asked = log.select("partition").distinct().withColumn("cursor_id", F.explode(F.array(F.lit("click"), F.lit("nobody"))))
    return _latest_or_none(asked, log)


_GROUP_CURSOR = """, cur AS (SELECT partition, CAST(max("offset") // 2 AS BIGINT) AS cursor_offset FROM log WHERE partition < 3 GROUP BY ALL), b AS (SELECT partition, max("offset") AS newest FROM log GROUP BY ALL)"""


@query("consumer_lag", LOG + _GROUP_CURSOR + " SELECT partition, newest, coalesce(cursor_offset, -1) AS cursor_offset, newest - coalesce(cursor_offset, -1) AS lag FROM b LEFT JOIN cur USING (partition)")
def consumer_lag(spark, sf_dir):
    log = events_log(spark, sf_dir)
    half = log.where("partition < 3").groupBy("partition").agg(F.floor(F.max("offset") / 2).alias("cursor_offset"))
    newest = log.groupBy("partition").agg(F.max("offset").alias("newest"))
    return commit.lag(newest, half, ["partition"])


@query("resume_from_cursor", LOG + _GROUP_CURSOR + ' SELECT partition, "offset", key FROM log LEFT JOIN cur USING (partition) WHERE "offset" > coalesce(cursor_offset, -1)')
def resume_from_cursor(spark, sf_dir):
    log = events_log(spark, sf_dir)
    half = log.where("partition < 3").groupBy("partition").agg(F.floor(F.max("offset") / 2).alias("cursor_offset"))
    return log.join(half, "partition", "left").where("offset > coalesce(cursor_offset, -1)").select("partition", "offset", "key")


@query("group_assign_single_stream", """WITH m AS (SELECT 's' || s_suppkey AS id, row_number() OVER (ORDER BY 's' || s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier)
SELECT p AS partition, id AS member FROM range(0, 12) t(p), m WHERE p % n = r""")  # fmt: skip
def group_assign_single_stream(spark, sf_dir):
    return _dealt(spark, table(spark, sf_dir, "supplier"))


def _dealt(spark: SparkSession, suppliers: DataFrame) -> DataFrame:
    """Twelve partitions of one stream, dealt to suppliers."""
    members = suppliers.select(F.lit("foo").alias("stream"), F.concat(F.lit("s"), "s_suppkey").alias("member"))
    return commit.assign_partitions(members, spark.createDataFrame([("foo", 12)], "stream string, partitions long")).drop("stream")


@query("group_assign_all_members", ORACLE_SQL["group_assign_single_stream"])
def group_assign_all_members(spark, sf_dir):
    return _dealt(spark, table(spark, sf_dir, "supplier"))


@query("group_assign_fold")
def group_assign_fold(spark, sf_dir):
    """Twenty conversations form a group; every third turn leaves it, the others join."""
    events = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 20).cast("long").alias("group"),
        F.struct("turn", "conv_id").alias("at"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("member"),
        F.when(F.col("turn") % 3 == 2, "leave").otherwise("join").alias("op"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("foo"), F.lit("bar"))).otherwise(F.array(F.lit("foo"))).alias("streams"),
    )
    line = Window.partitionBy("group").orderBy("at")
    return commit.fold_groups(events.withColumn("seq", F.row_number().over(line)).drop("at"), {"foo": 12, "bar": 5})


_BROKERS = "b AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey AS position, count(s_suppkey) AS load FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)"


def _brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    joined = nation.join(supplier, nation["n_nationkey"] == supplier["s_nationkey"], "left")
    return joined.groupBy(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").alias("position")).agg(F.count("s_suppkey").alias("load"))


@query("broker_load", f"WITH {_BROKERS} SELECT id, load FROM b")
def broker_load(spark, sf_dir):
    return _brokers(spark, sf_dir).select("id", "load")


@query("replica_placement", f"WITH {_BROKERS} SELECT id, load, row_number() OVER (ORDER BY load, position) AS rank FROM b QUALIFY rank <= 3")
def replica_placement(spark, sf_dir):
    return commit.choose_replicas(_brokers(spark, sf_dir), 3).select("id", "load", "rank")


@query("leader_selection", f"WITH {_BROKERS} SELECT arg_min(id, load * 1000 + position) AS leader FROM b")
def leader_selection(spark, sf_dir):
    return _brokers(spark, sf_dir).agg(F.min_by("id", F.struct("load", "position")).alias("leader"))


@query("metadata_unknown_streams", "SELECT name, CASE WHEN n_name IS NULL THEN 'UNKNOWN_STREAM' ELSE 'OK' END AS status FROM (VALUES ('FRANCE'), ('NATION_1'), ('nowhere')) v(name) LEFT JOIN nation ON n_name = name")
def metadata_unknown_streams(spark, sf_dir):
    asked = spark.createDataFrame([("FRANCE",), ("NATION_1",), ("nowhere",)], "name string")
    nation = table(spark, sf_dir, "nation")
    return asked.join(nation, asked["name"] == nation["n_name"], "left").select("name", F.when(F.col("n_name").isNull(), "UNKNOWN_STREAM").otherwise("OK").alias("status"))


@query("fanout_subject_wildcard", """WITH s AS (SELECT event_id, 'events.' || event_type || '.' || user_id AS subject FROM events)
SELECT stream, event_id, subject FROM s, (VALUES ('all', '^events\\..+$'), ('clicks', '^events\\.click\\.[^.]+$'), ('user7', '^events\\.[^.]+\\.7$')) v(stream, p) WHERE regexp_matches(subject, p)""")  # fmt: skip
def fanout_subject_wildcard(spark, sf_dir):
    bound = spark.createDataFrame([("all", "events.>"), ("clicks", "events.click.*"), ("user7", "events.*.7")], "stream string, pattern string")
    sent = raw_events(spark, sf_dir).select("event_id", F.concat_ws(".", F.lit("events"), "event_type", F.col("user_id").cast("string")).alias("subject"))
    return publish.fan_out(sent, bound).select("stream", "event_id", "subject")


@query("publish_preconditions", """SELECT o_orderkey, CASE WHEN name IN ('__activity', '__cursors') THEN 'RESERVED' WHEN name = 'missing' THEN 'NOT_FOUND' WHEN o_totalprice > 200000 THEN 'TOO_LARGE'
  WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'READONLY' WHEN o_orderkey % 5 = 0 THEN 'OCC_NEEDS_ACK' END AS error
FROM (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN '__cursors' WHEN 1 THEN 'missing' ELSE 'orders' END AS name FROM orders)""")  # fmt: skip
def publish_preconditions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "name", F.when(F.col("o_orderkey") % 7 == 0, "__cursors").when(F.col("o_orderkey") % 7 == 1, "missing").otherwise("orders")
    )
    streams = F.broadcast(spark.createDataFrame([("orders",)], "known string"))
    checked = orders.join(streams, F.col("name") == F.col("known"), "left")
    error = (
        F.when(F.col("name").isin(*RESERVED_STREAMS), "RESERVED")
        .when(F.col("known").isNull(), "NOT_FOUND")
        .when(F.col("o_totalprice") > 200_000, "TOO_LARGE")
        .when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), "READONLY")
        .when(F.col("o_orderkey") % 5 == 0, "OCC_NEEDS_ACK")
    )
    return checked.select("o_orderkey", error.alias("error"))


@query("acl_filter", "SELECT event_id FROM events WHERE (user_id % 2 = 0 AND event_type = 'click') OR (user_id % 2 = 1 AND event_type = 'view')")
def acl_filter(spark, sf_dir):
    policy = F.broadcast(spark.createDataFrame([("even", "click", "publish"), ("odd", "view", "publish")], "sub string, obj string, act string"))
    asked = raw_events(spark, sf_dir).select("event_id", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("sub"), F.col("event_type").alias("obj"), F.lit("publish").alias("act"))
    return asked.join(policy, ["sub", "obj", "act"], "left_semi").select("event_id")


@query("occ_accept", LOG.replace("WITH log", "WITH RECURSIVE log") + """, a AS (SELECT partition, "offset" AS n, CASE WHEN "offset" % 3 = 0 THEN -1 ELSE CAST(floor("offset" / 2) AS BIGINT) END AS expected FROM log),
f AS (
  SELECT partition, n, TRUE AS accepted, 0::BIGINT AS got, 1::BIGINT AS next FROM a WHERE n = 0
  UNION ALL
  SELECT a.partition, a.n, a.expected IN (-1, f.next), CASE WHEN a.expected IN (-1, f.next) THEN f.next END, f.next + CASE WHEN a.expected IN (-1, f.next) THEN 1 ELSE 0 END
  FROM f JOIN a ON a.partition = f.partition AND a.n = f.n + 1
) SELECT partition, n, accepted, got AS "offset" FROM f""")  # fmt: skip
def occ_accept(spark, sf_dir):
    return _tried(events_log(spark, sf_dir))


def _tried(log: DataFrame) -> DataFrame:
    expected = F.when(F.col("offset") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.col("offset") / 2)).cast("long")
    return seq.accept_expected(log.withColumn("n", F.col("offset")).withColumn("expected", expected), ["partition"], "n")


@query("occ_accept_all", ORACLE_SQL["occ_accept"])
def occ_accept_all(spark, sf_dir):
    return _tried(events_log(spark, sf_dir))


@query("auto_pause_gaps", LOG + """SELECT partition, "offset", ts_us - before AS idle_us FROM (SELECT *, lag(ts_us) OVER (PARTITION BY partition ORDER BY "offset") AS before FROM log) WHERE ts_us - before > 3600000000""")
def auto_pause_gaps(spark, sf_dir):
    return scan.idle_gaps(events_log(spark, sf_dir), 3_600_000_000).select("partition", "offset", "idle_us")


@query("consumer_expiry_sessions", """WITH g AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_id FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN b IS NULL OR t - b > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
SELECT user_id, min(t) AS first_us, max(t) AS last_us, count(*) AS beats FROM s GROUP BY user_id, session""")  # fmt: skip
def consumer_expiry_sessions(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts_us", "event_id")
    beats = raw_events(spark, sf_dir).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(line))
    beats = beats.withColumn("session", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 86_400_000_000), 1).otherwise(0)).over(line))
    return beats.groupBy("user_id", "session").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("beats")).drop("session")


@query("failover_quorum", LOG + "SELECT partition, leader_epoch, count(DISTINCT user_id) AS witnesses FROM sized WHERE event_type = 'error' GROUP BY ALL HAVING count(DISTINCT user_id) > (5 - 1) // 2")
def failover_quorum(spark, sf_dir):
    reports = sized_log(spark, sf_dir).where("event_type = 'error'")
    return reports.groupBy("partition", "leader_epoch").agg(F.count_distinct("user_id").alias("witnesses")).where("witnesses > 2")


_OPS = """WITH ops AS (SELECT event_id AS "index", 'stream' || (user_id % 20) AS name,
  CASE event_id % 11 WHEN 0 THEN 'create_stream' WHEN 1 THEN 'pause_stream' WHEN 2 THEN 'resume_stream' WHEN 3 THEN 'set_readonly' WHEN 4 THEN 'delete_stream'
                     WHEN 5 THEN 'join_group' WHEN 6 THEN 'leave_group' WHEN 7 THEN 'create_group' ELSE 'shrink_isr' END AS op FROM events)"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["create_stream", "pause_stream", "resume_stream", "set_readonly", "delete_stream", "join_group", "leave_group", "create_group"]
    op = F.coalesce(F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 11).cast("int")), F.lit("shrink_isr"))
    return raw_events(spark, sf_dir).select(F.col("event_id").alias("index"), op.alias("op"), F.concat(F.lit("stream"), (F.col("user_id") % 20).cast("string")).alias("name"))


_EVENT = """CASE op WHEN 'create_stream' THEN 'CREATE_STREAM' WHEN 'delete_stream' THEN 'DELETE_STREAM' WHEN 'pause_stream' THEN 'PAUSE_STREAM' WHEN 'resume_stream' THEN 'RESUME_STREAM'
  WHEN 'set_readonly' THEN 'SET_STREAM_READONLY' WHEN 'create_group' THEN 'JOIN_CONSUMER_GROUP' WHEN 'join_group' THEN 'JOIN_CONSUMER_GROUP' WHEN 'leave_group' THEN 'LEAVE_CONSUMER_GROUP' END"""


@query("activity_stream", _OPS + f' SELECT "index" AS id, {_EVENT} AS event, name FROM ops WHERE {_EVENT} IS NOT NULL')
def activity_stream(spark, sf_dir):
    return catalog.activity(_ops(spark, sf_dir))


@query("activity_dedupe", _OPS + f' SELECT DISTINCT "index" AS id, {_EVENT} AS event, name FROM ops WHERE {_EVENT} IS NOT NULL')
def activity_dedupe(spark, sf_dir):
    sent = catalog.activity(_ops(spark, sf_dir))
    return catalog.deduplicate(sent.unionByName(sent.where("id % 2 = 0")))


@query("catalog_fold", _OPS + """, n AS (SELECT name, max("index") FILTER (op = 'create_stream') AS c, max("index") FILTER (op = 'delete_stream') AS d, max("index") FILTER (op = 'pause_stream') AS p,
  max("index") FILTER (op = 'resume_stream') AS r, max("index") FILTER (op = 'set_readonly') AS o FROM ops GROUP BY name)
SELECT name, c AS epoch, CASE WHEN p > c THEN p ELSE -1 END > CASE WHEN r > c THEN r ELSE -1 END AS paused, coalesce(o > c, FALSE) AS readonly FROM n WHERE c IS NOT NULL AND (d IS NULL OR d < c)""")  # fmt: skip
def catalog_fold(spark, sf_dir):
    return catalog.fold(_ops(spark, sf_dir))


@query("isr_set_ops", "SELECT n_nationkey AS partition, 2::BIGINT AS without_leader, 3::BIGINT AS shrunk, 4::BIGINT AS expanded, n_regionkey IN (0, 1, 2) AS is_replica FROM nation")
def isr_set_ops(spark, sf_dir):
    isr = F.array(*map(F.lit, (0, 1, 2)))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("partition"),
        F.size(F.array_except(isr, F.array(F.lit(1)))).cast("long").alias("without_leader"),
        F.size(F.array_except(isr, F.array(F.lit(9)))).cast("long").alias("shrunk"),
        F.size(F.array_union(isr, F.array(F.lit(3)))).cast("long").alias("expanded"),
        F.array_contains(isr, F.col("n_regionkey")).alias("is_replica"),
    )


@query("throughput_stats", LOG + "SELECT partition, count(*) AS records, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(count(*) * 1000000.0 / (max(ts_us) - min(ts_us)), 9) AS per_second FROM sized GROUP BY partition")
def throughput_stats(spark, sf_dir):
    rate = F.round(F.count("*") * F.lit(1000000.0) / (F.max("ts_us") - F.min("ts_us")), 9)
    return sized_log(spark, sf_dir).groupBy("partition").agg(F.count("*").alias("records"), F.sum("size_bytes").alias("bytes"), rate.alias("per_second"))


@query("latency_percentiles", "SELECT event_type, round(min(value), 6) AS least, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    found = quantiles.summary(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p99": 0.99})
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("least", "p50", "p99", "most")))


@query("latency_summary", """SELECT event_type, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
  round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999, round(max(value), 6) AS most FROM events GROUP BY event_type""")  # fmt: skip
def latency_summary(spark, sf_dir):
    at = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    found = quantiles.summary(table(spark, sf_dir, "events"), "event_type", "value", at)
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("least", "mean", *at, "most")))


@query("envelope_decode", "SELECT doc_id, CAST(strlen(text) + 8 AS BIGINT) AS sent_bytes, text AS value, TRUE AS raw_is_value FROM documents")
def envelope_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", scalar.envelope(F.col("text")).alias("data"))
    raw = F.col("text").cast("binary")
    return docs.select("doc_id", F.octet_length("data").cast("long").alias("sent_bytes"), scalar.envelope_value(F.col("data")).cast("string").alias("value"), (scalar.envelope_value(raw) == raw).alias("raw_is_value"))


@query("encrypt_roundtrip", "SELECT doc_id, TRUE AS same, CAST(strlen(text) + 28 AS BIGINT) AS sealed_bytes FROM documents")
def encrypt_roundtrip(spark, sf_dir):
    key = F.lit("0123456789abcdef0123456789abcdef")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.aes_encrypt("text", key, F.lit("GCM")).alias("sealed"))
    return docs.select("doc_id", (F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string") == F.col("text")).alias("same"), F.octet_length("sealed").cast("long").alias("sealed_bytes"))


@query("stream_sequence_available_now", LOG + 'SELECT partition, "offset", event_id FROM log')
def stream_sequence_available_now(spark, sf_dir):
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    raw = source.select(F.pmod("user_id", F.lit(4)).cast("int").alias("partition"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id")
    return drain_sequenced(raw, scratch.root(spark)).select("partition", "offset", "event_id")


@query("union_streams", LOG + """SELECT stream, partition, "offset", key FROM log UNION ALL
SELECT 'conversations', CAST(conv_id % 4 AS INTEGER), row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) - 1, CAST(conv_id AS VARCHAR) FROM conversations""")  # fmt: skip
def union_streams(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("stream"), F.pmod("conv_id", F.lit(4)).cast("int").alias("partition"), "conv_id", "turn", F.col("conv_id").cast("string").alias("key"))
    talk = seq.sequence(talk, ["stream", "partition"], ["conv_id", "turn"], bucket=F.floor(F.col("conv_id") / 1000))
    return events_log(spark, sf_dir).select("stream", "partition", "offset", "key").unionByName(talk.select("stream", "partition", "offset", "key"))
