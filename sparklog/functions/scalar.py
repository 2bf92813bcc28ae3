"""Scalar functions of the log as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_partition(key: Column, n: int) -> Column:
    """The CRC-32 of a key, unsigned, modulo n; a null key hashes like an empty one; n = 0 gives 0."""
    if n == 0:
        return F.lit(0)
    return F.pmod(F.crc32(F.coalesce(key.cast("binary"), F.lit("").cast("binary"))), F.lit(n)).cast("int")


def partition_subject(subject: Column, partition: Column) -> Column:
    return F.when(partition == 0, subject).otherwise(F.concat_ws(".", subject, partition.cast("string")))


def cursor_key(cursor: Column, stream: Column, partition: Column) -> Column:
    return F.concat_ws(",", cursor, stream, partition.cast("string"))


def segment_file(base: Column) -> Column:
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(".log"))


def valid_subject(subject: Column) -> Column:
    """No white space and no empty token."""
    return ~subject.rlike(r"[ \t\r\n]") & ~F.array_contains(F.split(subject, r"\."), "")


def subject_matches(subject: Column, pattern: Column) -> Column:
    """Bus wildcards: ``*`` stands for one token, a final ``>`` for one or more."""
    quoted = F.regexp_replace(pattern, r"\.", r"\\.")
    return F.regexp_like(subject, F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", "[^.]+"), ">", ".+"), F.lit("$")))


#: Fixed values of the envelope: magic number, version, least header length.
ENVELOPE_MAGIC, ENVELOPE_HEADER = "B90E43B4", 8


def envelope(payload: Column, kind: int = 0) -> Column:
    """Magic, version 0, header length, flags 0, kind, then the payload."""
    head = f"{ENVELOPE_MAGIC}00{ENVELOPE_HEADER:02X}00{kind:02X}"
    return F.concat(F.unhex(F.lit(head)), payload.cast("binary"))


def envelope_value(data: Column, kind: int = 0) -> Column:
    """The payload of an envelope of this kind; other data is a value as it stands."""
    head = F.hex(F.substring(data, 1, ENVELOPE_HEADER))
    good = head == F.lit(f"{ENVELOPE_MAGIC}00{ENVELOPE_HEADER:02X}00{kind:02X}")
    return F.when(good, F.substring(data, ENVELOPE_HEADER + 1, 2**31 - 1 - ENVELOPE_HEADER)).otherwise(data)


def replication_response(payload: Column) -> dict[str, Column]:
    """epoch, hw and data of a replication response: two numbers of eight bytes, then the records.

    All three are null for a payload of fewer than 16 bytes. Epochs and offsets stay far below
    the last bit, so the seven low bytes of each tell it, unless all bytes are set: -1.
    """
    whole = F.octet_length(payload) >= 16

    def number(start: int) -> Column:
        eight = F.hex(F.substring(payload, start, 8))
        return F.when(whole, F.when(eight == "F" * 16, F.lit(-1).cast("long")).otherwise(F.conv(F.substring(eight, 3, 14), 16, 10).cast("long")))

    return {"epoch": number(1), "hw": number(9), "data": F.when(whole, F.substring(payload, 17, 2**31 - 17))}


def has_bit(n: Column, position: int) -> Column:
    return F.shiftright(n, position).bitwiseAND(F.lit(1)) == 1


def tick(elapsed: Column, most: Column | int) -> Column:
    """How long to sleep before the next check; the whole time if it has passed already."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.when(most - elapsed < 0, most).otherwise(most - elapsed)


def backoff(previous: Column, first: int = 1, most: int = 10) -> Column:
    """Seconds to wait after a failure: 1, then twice the time before, at most 10."""
    return F.when(previous == 0, F.lit(first)).otherwise(F.least(previous * 2, F.lit(most)))


def override(value: Column, default: Column | int, scale: int = 1) -> Column:
    """A stream's own setting if it has one, else the default; a setting of 0 is a setting."""
    return F.coalesce(value * scale, F.lit(default) if isinstance(default, int) else default)


def milliseconds(value: Column) -> Column:
    """A duration override as nanoseconds."""
    return value * 1_000_000


def retention_text(messages: Column, size: Column, age_s: Column, compact: Column) -> Column:
    """What a stream keeps, for people; limits of 0 are none."""
    parts = F.array(
        F.when(messages != 0, F.concat(F.lit("Messages: "), F.format_number(messages, 0))),
        F.when(size != 0, F.concat(F.lit("Size: "), size.cast("string"), F.lit(" B"))),
        F.when(age_s > 0, F.concat(F.lit("Age: "), age_s.cast("string"), F.lit(" s"))),
    )
    limits = F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", ")
    return F.concat(F.lit("["), F.when(limits == "", "no limits").otherwise(limits), F.lit(", Compact: "), compact.cast("string"), F.lit("]"))


def auto_pause_text(seconds: Column) -> Column:
    return F.when(seconds > 0, F.concat(seconds.cast("string"), F.lit(" s"))).otherwise("disabled")


def server_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def balanced_stream(key: Column, streams: int) -> Column:
    """The one stream of a load-balance group that gets a message, by its key's checksum."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(streams)).cast("int")
