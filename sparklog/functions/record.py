"""The stored record: its body as bytes, its size, its fields, and what a consumer is delivered."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.schema import RECORD_BYTES, SET_HEADER_BYTES

#: The record's version, and the headers that ingest writes and delivery lifts.
MAGIC, SUBJECT, REPLY = 1, "subject", "reply"
#: Fixed value: the reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


def _length(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0))


def headers_size(headers: Column) -> Column:
    """Bytes of all headers: two for a name's length, four for a value's; none for null."""
    each = lambda a, x: a + 6 + _length(x["key"]) + _length(x["value"])
    return F.coalesce(F.aggregate(F.map_entries(headers), F.lit(0), each), F.lit(0))


def record_size(key: str = "key", value: str = "value", headers: str | None = None) -> Column:
    """Bytes of a stored record: set header, fixed fields, key, value and headers."""
    size = F.lit(SET_HEADER_BYTES + RECORD_BYTES) + _length(F.col(key)) + _length(F.col(value))
    return (size if headers is None else size + headers_size(F.col(headers))).cast("long")


def header(headers: Column, name: str) -> Column:
    """A header as text; null where there is none."""
    return F.try_element_at(headers, F.lit(name)).cast("string")


def with_subject(headers: Column, subject: Column, reply: Column) -> Column:
    """Headers as ingest stores them: a client's own subject and reply are overwritten."""
    own = F.map_filter(F.coalesce(headers, F.create_map().cast("map<string,binary>")), lambda k, _: ~k.isin(SUBJECT, REPLY))
    return F.map_concat(own, F.create_map(F.lit(SUBJECT), subject.cast("binary"), F.lit(REPLY), reply.cast("binary")))


def delivered(log: DataFrame) -> DataFrame:
    """What a consumer sees: subject and reply are lifted out of the headers, an empty one is null."""
    lift = lambda name: F.nullif(header(F.col("headers"), name), F.lit(""))
    return log.select("stream", "partition", "offset", "key", "value", "ts_us", "headers", lift(SUBJECT).alias("subject"), lift(REPLY).alias("reply_subject"))


def _number(n: Column, width: int) -> Column:
    """A whole number as so many big-endian bytes."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2 * width)))


def _bytes(c: Column) -> Column:
    """A length of four bytes, -1 for null, then the bytes."""
    raw = c.cast("binary")
    return F.concat(F.when(raw.isNull(), F.unhex(F.lit("FFFFFFFF"))).otherwise(_number(F.octet_length(raw), 4)), F.coalesce(raw, F.lit("").cast("binary")))


def body(key: Column, value: Column, headers: Column | None = None, attributes: int = 0) -> Column:
    """A record without its checksum: magic, attributes, key, value, and the headers by name."""
    parts = [_number(F.lit(MAGIC), 1), _number(F.lit(attributes), 1), _bytes(key), _bytes(value)]
    if headers is None:
        return F.concat(*parts, _number(F.lit(0), 2))
    listed = F.array_sort(F.map_entries(headers), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    each = lambda a, x: F.concat(a, _number(F.octet_length(x["key"]), 2), x["key"].cast("binary"), _bytes(x["value"]))
    count = _number(F.coalesce(F.size(F.map_keys(headers)), F.lit(0)), 2)
    return F.concat(*parts, count, F.coalesce(F.aggregate(listed, F.lit("").cast("binary"), each), F.lit("").cast("binary")))


def whole_number(data: Column, start: Column | int, width: int) -> Column:
    """The unsigned big-endian number of so many bytes (seven at most) from a place, from 1 on."""
    part = F.substring(data, start, width) if isinstance(start, int) else data.substr(start, F.lit(width))
    return F.conv(F.hex(part), 16, 10).cast("long")


def fields(data: Column) -> dict[str, Column]:
    """magic, attributes, key, value and the number of headers of a body; a length of -1 is null."""
    null = 2**32 - 1
    nk = whole_number(data, 3, 4)
    key_end = F.when(nk == null, F.lit(0)).otherwise(nk) + 7
    nv = whole_number(data, key_end, 4)
    value_end = F.when(nv == null, F.lit(0)).otherwise(nv) + key_end + 4
    return {
        "magic": whole_number(data, 1, 1),
        "attributes": whole_number(data, 2, 1),
        "key": F.when(nk != null, data.substr(F.lit(7), nk.cast("int"))),
        "value": F.when(nv != null, data.substr((key_end + 4).cast("int"), nv.cast("int"))),
        "n_headers": whole_number(data, value_end.cast("int"), 2),
    }


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(CASTAGNOLI), out >> 1).astype(np.uint32)
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C, unsigned; null for null. All rows of a batch advance byte by byte together."""
    table, raw = _table(), [x if x is not None else b"" for x in data]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    joined = np.frombuffer(b"".join(raw[i] for i in order), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    crc = np.full(len(raw), 0xFFFFFFFF, dtype=np.uint32)
    live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left") if len(raw) else []
    for at, n in enumerate(live):
        now = crc[:n]
        crc[:n] = table[(now ^ joined[starts[:n] + at]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty(len(raw), dtype=np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return pd.Series(out).astype("Int64").mask(data.isna())


def is_intact(stored: Column, key: Column, value: Column, headers: Column | None = None) -> Column:
    """Whether the stored checksum is that of the record's body."""
    return stored == crc32c(body(key, value, headers))
