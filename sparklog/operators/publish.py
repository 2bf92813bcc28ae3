"""Publishing: checks, offsets, acknowledgements by correlation id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions.scalar import subject_matches
from sparklog.operators.sequence import accept_expected, sequence
from sparklog.schema import MAX_PAYLOAD_BYTES, RESERVED_STREAMS

BY = ["stream", "partition"]


def refuse(messages: DataFrame, streams: DataFrame, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """messages with error (null: none), in the order in which a publisher meets the checks.

    ``messages`` has stream, partition, value, ack_policy and expected_offset (null or -1: any);
    ``streams`` has stream, partitions, readonly and occ (optimistic concurrency). This is the
    catalog, small beside the messages, so it goes to them: one stream can have most messages, and
    their values are not shuffled by it.
    """
    known = streams.select(F.col("stream").alias("_stream"), "partitions", "readonly", "occ")
    found = messages.join(F.broadcast(known), messages["stream"] == F.col("_stream"), "left")
    error = (
        F.when(F.col("stream").isin(*RESERVED_STREAMS), "RESERVED")
        .when(F.col("_stream").isNull(), "NOT_FOUND")
        .when(~F.col("partition").between(0, F.col("partitions") - 1), "NO_SUCH_PARTITION")
        .when(F.col("readonly"), "READONLY")
        .when(F.col("occ") & (F.col("ack_policy") == "NONE"), "OCC_NEEDS_ACK")
        .when(F.octet_length("value") > max_bytes, "TOO_LARGE")
    )
    return found.select(*messages.columns, F.coalesce("occ", F.lit(False)).alias("occ"), error.alias("error"))


def publish(messages: DataFrame, streams: DataFrame, order: str, bucket: Column, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """messages with offset and error: what was refused takes no offset.

    Streams without concurrency control are sequenced; in the others an expected offset must be
    the next one, so their attempts are folded in order.
    """
    checked = refuse(messages, streams, max_bytes)
    free = sequence(checked.where("error is null and not occ"), BY, [order], bucket)
    tried = checked.where("error is null and occ")
    slim = tried.select(*BY, order, F.coalesce("expected_offset", F.lit(-1)).cast("long").alias("expected"))
    folded = accept_expected(slim, BY, order)
    tried = tried.join(folded, [*BY, order]).withColumn("error", F.when(~F.col("accepted"), "INCORRECT_OFFSET")).drop("accepted")
    refused = checked.where("error is not null").withColumn("offset", F.lit(None).cast("long"))
    return free.unionByName(tried).unionByName(refused).drop("occ")


def acks(published: DataFrame) -> DataFrame:
    """The acknowledgements that are sent: a message without an inbox, or with policy NONE, gets
    none, but errors are always told to an inbox."""
    sent = published.where("ack_inbox is not null and (ack_policy != 'NONE' or error is not null)")
    return sent.select("ack_inbox", "correlation_id", *BY, "offset", "ack_policy", "error")


def outcomes(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """messages with the acknowledgement of their correlation id: acked, refused or silent."""
    told = sent.select("correlation_id", F.col("offset").alias("ack_offset"), F.col("error").alias("ack_error"), F.lit(True).alias("_told"))
    outcome = F.when(F.col("_told").isNull(), "silent").when(F.col("ack_error").isNull(), "acked").otherwise("refused")
    return messages.join(told, "correlation_id", "left").withColumn("outcome", outcome).drop("_told")


def fan_out(messages: DataFrame, bindings: DataFrame) -> DataFrame:
    """A row for each message and each stream bound to its subject.

    ``bindings`` has stream and pattern, in which ``*`` stands for one token and a last ``>`` for
    one or more. Patterns without a wildcard are equal subjects; the others have their tokens up
    to the first wildcard in common with the subject, and meet it by those, so no pattern is held
    against all subjects (but those that begin with a wildcard). Most subjects can begin alike, so
    the bindings, part of the catalog, go to the messages, which are read once and not shuffled.
    """
    tokens = F.split("pattern", r"\.")
    place = lambda x: F.array_position(tokens, F.lit(x))
    first = F.array_min(F.filter(F.array(place("*"), place(">")), lambda i: i > 0))
    listed = bindings.select("stream", "pattern", F.coalesce(first - 1, F.lit(-1)).cast("int").alias("_fixed"))  # -1: all
    head = lambda of, n: F.array_join(F.slice(of, F.lit(1), n), ".")
    listed = listed.withColumn("_head", F.when(F.col("_fixed") < 0, F.col("pattern")).otherwise(head(tokens, F.greatest("_fixed", F.lit(0)))))
    lengths = sorted(r["_fixed"] for r in listed.select("_fixed").distinct().collect())  # as many as a subject has tokens
    if not lengths:
        return messages.join(F.broadcast(bindings.select("stream")), F.lit(False)).select("stream", *messages.columns)
    parts = F.split("subject", r"\.")
    beginnings = [F.struct(F.lit(n).alias("_fixed"), (head(parts, F.lit(n)) if n >= 0 else F.col("subject")).alias("_head")) for n in lengths]
    met = messages.withColumn("_at", F.explode(F.array(*beginnings))).select(*messages.columns, "_at.*").join(F.broadcast(listed), ["_fixed", "_head"])
    return met.where((F.col("_fixed") < 0) | subject_matches(F.col("subject"), F.col("pattern"))).select("stream", *messages.columns)


def first_acks(fanned: DataFrame, key: str, written: str) -> DataFrame:
    """Of the streams that a message went to, the one that acknowledges first.

    Nearly every key is met in one task only, so rows are dealt by it before they are aggregated,
    and not sorted twice.
    """
    dealt = fanned.repartition(key)
    return dealt.groupBy(key).agg(F.min_by("stream", F.struct(written, "stream")).alias("stream"), F.min(written).alias(written))


def batches(log: DataFrame, size: int = 1024) -> DataFrame:
    """Add batch: consecutive records of a partition, so many at a time."""
    return log.withColumn("batch", F.floor(F.col("offset") / size))
