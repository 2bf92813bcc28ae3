"""The log's envelope. A log is a DataFrame with these columns; a payload is opaque bytes."""

from __future__ import annotations

from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("stream", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("timestamp_ns", T.LongType(), False),
        T.StructField("leader_epoch", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", T.MapType(T.StringType(), T.BinaryType())),
    ]
)
#: Bytes of a stored record besides key, value and headers, and of a set's header.
RECORD_BYTES, SET_HEADER_BYTES = 16, 28
RESERVED_STREAMS = ("__activity", "__cursors")
MAX_PAYLOAD_BYTES = 1 << 20
