"""Op 3: put documents into shards by a hierarchical weighted hash tree.

A topology lists shards with their region, rack and weight. A document descends it: at each
level every child draws -ln(u) / weight, u a hash of the document's key and the child's name,
and the least draw wins, so that a child wins in proportion to the weight below it. When the
weight of one subtree grows, rows move only into that subtree, and only along the path whose
weights changed; all other draws stay as they were.

Law of this operator: ``key``. A shard added in a region of its own takes rows only into itself.

Defined cases: a null key hashes like any other value; a null text has size 1 and the CRC of
the empty string; repeated rows go to the same shard and get slots of their own; an empty table
gives an empty table; columns besides the key and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import gapless_rank, materialize, table, with_row_position


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_topology(regions: int, racks: int, shards: int) -> list[Leaf]:
    """regions x racks x shards leaves of weight 1, numbered in order."""
    return [
        Leaf(f"r{i}", f"r{i}/k{j}", (i * racks + j) * shards + k)
        for i in range(regions)
        for j in range(racks)
        for k in range(shards)
    ]


def grow(topology: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: rows move into it and nowhere else."""
    shard = max(x.shard for x in topology) + 1
    return [*topology, Leaf(f"g{shard}", f"g{shard}/k0", shard, weight)]


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; equal draws go to the lesser value."""
    draws = []
    for node, weight, value in children:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11) + F.lit(0.5)) / F.lit(float(2**53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), value.alias("value")))
    return F.array_min(F.array(*draws))["value"]


def _case(on: Column, branches: list[tuple[str, Column]]) -> Column:
    out = None
    for name, value in branches:
        out = F.when(on == name, value) if out is None else out.when(on == name, value)
    return out


def place(df: DataFrame, topology: list[Leaf], key: str, out: str) -> DataFrame:
    """Add the column ``out``, the shard of each row's key."""
    leaves = [x for x in topology if x.weight > 0]
    if not leaves:
        raise ValueError("a topology needs a shard of positive weight")
    racks: dict[str, dict[str, list[Leaf]]] = {}
    for x in sorted(leaves, key=lambda x: x.shard):
        racks.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    total = lambda xs: sum(x.weight for x in xs)
    k = F.col(key)
    region = _winner(k, [(r, sum(map(total, sub.values())), F.lit(r)) for r, sub in racks.items()])
    rack = _case(
        F.col("_region"),
        [(r, _winner(k, [(q, total(xs), F.lit(q)) for q, xs in sub.items()])) for r, sub in racks.items()],
    )
    shard = _case(
        F.col("_rack"),
        [
            (q, _winner(k, [(f"{q}/s{x.shard}", x.weight, F.lit(x.shard)) for x in xs]))
            for sub in racks.values()
            for q, xs in sub.items()
        ],
    )
    return (
        df.withColumn("_region", region)
        .withColumn("_rack", rack)
        .withColumn(out, shard.cast("int"))
        .drop("_region", "_rack")
    )


def shard_documents(
    docs: DataFrame,
    topology: list[Leaf],
    grown: list[Leaf] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Shard and gapless slot of every row: key, size, text_crc32, shard, grown_shard, slot.

    The text is read once and only its size and CRC go on. Slots follow the key's order: rows
    are dealt by ranges of (shard, key, input position), so a key that repeats without end is
    still split over tasks.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(key),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_at"),
    )
    placed = place(sized, topology, key, "shard")
    placed = place(placed, grown, key, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    order = ["shard", key, "_at"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(with_row_position(dealt), "shards")
    return gapless_rank(stored, ["shard"], "slot").select(key, "size", "text_crc32", "shard", "slot", "grown_shard")


def op3_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards: two regions of two racks of two shards; grown: a ninth."""
    topology = even_topology(2, 2, 2)
    out = shard_documents(table(spark, sf_dir, "documents"), topology, grow(topology))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
