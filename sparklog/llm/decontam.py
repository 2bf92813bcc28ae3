"""Op 1: find benchmark items in documents.

Texts are lower-cased runs of letters and digits; shingles are five words, weighted by how few
benchmark items hold them (a shingle of no item weighs as much as one of a single item). A
document leaks an item if one of its windows of the item's size (cut where the text ends) has a
weighted Jaccard similarity of 0.8 or more with it, over the sets of shingles.

1. *Windows.* Only a window that shares shingles weighing 0.8 of an item of its size can be
   similar to it, in whatever order they stand. A document's shared shingles are grouped by tiles
   of the item's size, each with its neighbour, so that every window lies in one group; of a
   group's starts those with enough shared weight in their window are taken, and no others.
2. *SimHash.* Windows and items get 64-bit fingerprints of their weighted shingles.
3. *Multi-index.* Two fingerprints within RADIUS bits agree to within RADIUS // 4 bits in one of
   four blocks of 16 bits, so the index lists every block value that near each item's, and
   looking up a window's four blocks finds every item of its size within the radius. An unrelated
   item meets a window in about one lookup of 23. Equal fingerprints are looked up once, and the
   index is shuffled, as it has 2,788 rows an item. At similarity 0.8 fingerprints differ in ten
   bits on average, so that the radius is nearly two deviations off, more for closer pairs.
4. *Verification* by the exact weighted similarity.

Defined cases: null text has no words; items of fewer than five words are too short to be
evidence and match nothing; documents with one id and different texts are told apart by their
texts' hashes, equal rows are reported once; equal items are reported each; a null id is kept as
it is; empty tables give an empty result; other columns are ignored, and drop_leaks() keeps them.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import materialize, same_row, table

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS = 4
#: Shingles of the benchmark up to which its tables are broadcast; larger ones are shuffled.
BROADCAST_SHINGLES = 500_000
#: Documents with windows to look at up to which their ids and hashes are broadcast, to pick their
#: texts where they lie; more of them meet all texts by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Pairs of a window's fingerprint and an item near it up to which they are broadcast to the windows.
BROADCAST_CODES = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: str) -> Column:
    """The hash of every five words, in order."""
    at = lambda i, k: F.get(F.col(words), i + k)
    every = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(at(i, k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, every).otherwise(F.array().cast("array<bigint>"))


def fingerprint(g: str = "g", w: str = "w") -> Column:
    """The SimHash of a group of rows: bit b is set if the shingles with bit b weigh more than the others."""
    bits = []
    for b in range(64):
        vote = F.sum(F.when(F.shiftright(F.col(g), b).bitwiseAND(F.lit(1)) == 1, F.col(w)).otherwise(-F.col(w)))
        bits.append(F.when(vote > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def weight(n_items: int, df: int) -> int:
    """The weight of a shingle that df of n_items hold."""
    return int(100 * (1 + log(n_items / df)) + 0.5)


def _places(hits: DataFrame) -> DataFrame:
    """id, th and the (start, size) of every window whose shared shingles may weigh enough for an item."""
    n = F.col("size") - (SHINGLE - 1)
    tile = F.expr(f"p div (size - {SHINGLE - 1})").cast("int")
    tiled = hits.select("*", F.explode(F.array(tile, tile + 1)).alias("tile")).where("tile > 0")
    groups = tiled.groupBy("id", "th", "item", "ih", "size", "weight", "tile").agg(F.collect_set(F.struct("p", "g", "w")).alias("hits"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["w"])
    least = THRESHOLD * F.col("weight")
    likely = groups.where(total(F.array_distinct(F.transform("hits", lambda x: F.struct(x["g"], x["w"].alias("w"))))) >= least)
    inside = lambda s: F.filter("hits", lambda x: (x["p"] >= s) & (x["p"] < s + n))
    starts = F.filter(F.sequence((F.col("tile") - 1) * n, F.col("tile") * n - 1), lambda s: total(inside(s)) >= least)
    places = likely.select("id", "th", "size", F.explode(starts).alias("start"))
    return places.groupBy("id", "th").agg(F.collect_set(F.struct("start", "size")).alias("places"))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key, _th (the text's hash), item, start_word and similarity: the best window of each pair."""
    bench = items.select(F.col(item).alias("item"), F.col(text).alias("t")).distinct()
    bench = bench.select("item", F.xxhash64("t").alias("ih"), tokens(F.col("t")).alias("w")).where(F.size("w") >= SHINGLE)
    listed = bench.select("item", "ih", F.size("w").alias("size"), F.posexplode(shingles("w")).alias("q", "g"))
    listed = materialize(listed, "bench")
    counts = listed.groupBy("g").agg(F.count_distinct("item", "ih").alias("df"))
    n_items = max(1, bench.count())
    heaviest = weight(n_items, 1)
    weights = counts.select("g", F.round(100 * (1 + F.log(F.lit(float(n_items)) / F.col("df")))).cast("long").alias("w"))
    weights = materialize(weights, "bench_weights")
    each = listed.select("item", "ih", "size", "g").distinct().join(weights, "g")
    sets = materialize(
        each.groupBy("item", "ih", "size").agg(F.collect_list(F.struct("g", "w")).alias("gs"), F.sum("w").alias("weight"), fingerprint().alias("code")),
        "bench_items",
    )
    entries = materialize(sets.select("item", "ih", "size", "weight", F.explode("gs").alias("x")).select("item", "ih", "size", "weight", "x.g", "x.w"), "bench_shingles")
    near = F.broadcast if entries.count() <= BROADCAST_SHINGLES else (lambda df: df)

    source = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    spread = (
        source.select("id", "th", tokens(F.col("t")).alias("words"))
        .select("id", "th", shingles("words").alias("gs"))
        .select("id", "th", F.posexplode_outer("gs").alias("p", "g"))  # the plain one would evaluate gs in a filter as well
    )
    places = materialize(_places(spread.join(near(entries), "g")), "places")

    if places.count() <= BROADCAST_KEYS:
        keys = F.broadcast(places.select("id", "th"))
        source = source.join(keys, same_row(source, keys, ["id", "th"]), "left_semi")
    held = source.join(places, same_row(source, places, ["id", "th"])).select(source["id"], source["th"], "t", "places")
    held = held.groupBy("id", "th").agg(F.first("t").alias("t"), F.first("places").alias("places"))
    cut = (
        held.select("id", "th", "places", tokens(F.col("t")).alias("words"))
        .select("id", "th", "places", shingles("words").alias("gs"))
        .select("id", "th", "gs", F.explode("places").alias("at"))
        .where(F.col("at.start") < F.size("gs"))
        .select(
            "id", "th", "at.start", "at.size",
            F.explode(F.array_distinct(F.slice("gs", F.col("at.start") + 1, F.col("at.size") - (SHINGLE - 1)))).alias("g"),
        )
    )
    weighed = cut.join(near(weights), "g", "left").withColumn("w", F.coalesce("w", F.lit(heaviest).cast("long")))
    windows = materialize(
        weighed.groupBy("id", "th", "start", "size").agg(
            fingerprint().alias("code"), F.sum("w").alias("wide"), F.collect_list("g").alias("own")
        ),
        "windows",
    )
    found = _within_radius(windows, sets)
    both = F.aggregate(F.filter("gs", lambda x: F.array_contains("own", x["g"])), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    alike = found.withColumn("both", both).withColumn("similarity", F.col("both") / (F.col("wide") + F.col("weight") - F.col("both")))
    alike = alike.where(F.col("similarity") >= THRESHOLD)
    best = alike.groupBy("id", "th", "item", "ih").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
    return best.select(
        F.col("id").alias(key),
        F.col("th").alias("_th"),
        F.col("item").alias(item),
        (-F.col("best.before")).cast("long").alias("start_word"),
        F.round("best.similarity", 6).alias("similarity"),
    )


def _within_radius(windows: DataFrame, sets: DataFrame) -> DataFrame:
    """Windows with the items of their size whose fingerprints are within RADIUS bits."""
    bits = 64 // BLOCKS
    block = lambda code, b: F.shiftrightunsigned(F.col(code), bits * b).bitwiseAND(F.lit(2**bits - 1)).cast("int")
    masks = ",".join(str(m) for m in range(2**bits) if m.bit_count() <= RADIUS // BLOCKS)
    masks = F.split(F.lit(masks), ",").cast("array<int>")

    def around(b: int) -> Column:
        """Block b of the item's code and the values near it."""
        return F.transform(masks, lambda m: F.struct(F.lit(b).alias("b"), m.bitwiseXOR(block("code", b)).alias("v")))

    listed = F.explode(F.concat(*map(around, range(BLOCKS)))).alias("x")
    index = sets.select("item", "ih", "size", F.col("code").alias("item_code"), listed)
    index = index.select("item", "ih", "size", "item_code", "x.b", "x.v")
    asked = windows.select("size", "code").distinct()  # copies of a text ask once
    asked = asked.select("size", "code", F.explode(F.array(*(F.struct(F.lit(b).alias("b"), block("code", b).alias("v")) for b in range(BLOCKS)))).alias("x"))
    asked = asked.select("size", "code", "x.b", "x.v")
    # Spark takes the index for as small as the table of items that it comes from; hence the hint
    pairs = asked.join(index.hint("merge"), ["size", "b", "v"])
    pairs = pairs.where(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= RADIUS)
    pairs = materialize(pairs.select("size", "code", "item", "ih").distinct(), "near_codes")
    near = F.broadcast if pairs.count() <= BROADCAST_CODES else (lambda df: df)
    full = windows.select("id", "th", "start", "size", "code", "wide", "own").join(near(pairs), ["size", "code"]).drop("code")
    what = sets.select(F.col("item").alias("s_item"), F.col("ih").alias("s_ih"), "gs", "weight")
    return full.join(what, full["item"].eqNullSafe(F.col("s_item")) & (full["ih"] == F.col("s_ih"))).drop("s_item", "s_ih")


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that leak an item."""
    held = docs.select(F.struct(*docs.columns).alias("_d"), F.xxhash64(text).alias("_th"))
    leaks = find_leaks(docs, items, key, text).select(F.col(key).alias("_id"), F.col("_th").alias("_hash")).distinct()
    on = held[f"_d.{key}"].eqNullSafe(leaks["_id"]) & (held["_th"] == leaks["_hash"])
    return held.join(leaks, on, "left_anti").select(*(F.col(f"_d.{c}").alias(c) for c in docs.columns))


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_th")
