"""Sealing values: what a codec has to offer, and one of AES-GCM with a data key of each message's own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Codec(Protocol):
    """Both take and return columns of bytes."""

    def seal(self, value: Column, salt: Column) -> Column: ...

    def read(self, data: Column) -> Column: ...


class AesCodec:
    """The wrapped data key's length in one byte, the wrapped key, then the sealed value.

    The data key is drawn from the master key and a salt, wrapped under the master key by AES-GCM
    (nonce, key, tag), and seals the value likewise. Reading unwraps the key first.
    """

    def __init__(self, master: str) -> None:
        if len(master.encode()) != 32:
            raise ValueError("the master key has 32 bytes")
        self.master = F.lit(master)

    def seal(self, value: Column, salt: Column) -> Column:
        key = F.unhex(F.sha2(F.concat(self.master.cast("binary"), salt.cast("string").cast("binary")), 256))
        wrapped = F.aes_encrypt(key, self.master, F.lit("GCM"))
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(wrapped).cast("long")), 2, "0")), wrapped, F.aes_encrypt(value.cast("binary"), key, F.lit("GCM")))

    def read(self, data: Column) -> Column:
        """Null for data that is not sealed by this key."""
        size = F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")
        key = F.try_aes_decrypt(data.substr(F.lit(2), size), self.master, F.lit("GCM"))
        return F.try_aes_decrypt(data.substr(size + 2, F.octet_length(data) - size - 1), key, F.lit("GCM"))


#: A partitioner gives the column of the partition for messages with stream, key and value.
Partitioner = Callable[[DataFrame, int], Column]


def assign_partition(messages: DataFrame, partitioner: Partitioner, partitions: int) -> DataFrame:
    """messages with partition, by any rule."""
    return messages.withColumn("partition", partitioner(messages, partitions).cast("int"))
