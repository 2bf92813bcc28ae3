"""Op 9: documents whose sets of word n-grams have a Jaccard similarity of at least t.

The join is the sparse product of the document by n-gram incidence matrix with its transpose,
cut into blocks that can hold a result. Sizes bound everything: a set x of s n-grams that links
with y lacks at most k = s - ceil(t s) of its own in y, their overlap is at least
t (|x| + |y|) / (1 + t), and their sizes lie within the factor t.

1. *Rows.* Of the s n-grams in the order of their hashes, the first m = 1.5 k + 1 hold m - k that
   y holds as well, and those stand early in y too. So each set lists its early columns, columns
   listed twice or more are found, and only sets with m - k of them among their first m remain.
   Sets of mostly their own words go here, at the price of a part of their columns, which are
   counted as packed 32-bit numbers of a bucket.
2. *Columns.* On the rows that remain every column is counted. With the rarest columns first, two
   linked sets share one of their first k + 1, so only those are multiplied. A column of one row
   brings no product and is left out.
3. *Products.* First every set meets the most central set that it shares such a column with, which
   joins most groups of near copies in as many products as they have members. Where the members
   of a column then still lie in several parts, the clusters that such columns hold together are
   cut into chunks of bounded size, and each pair of chunks whose sizes can match is one block
   product: overlap counts are accumulated column by column in memory, dense for frequent n-grams
   and pair by pair for rare ones, and counts below the bound are discarded. A block returns the
   links as a forest, a row for each set at most, never its pairs, and chunks of one part are
   not multiplied with each other.
4. *Components* of the links, with the least document id of each.

No link is lost: sets that share no column of step 2 can't link, and those that share one are
either connected already or meet in a block. Equal sets are one class throughout. N-grams are
named by 64-bit hashes; equal 32-bit numbers of step 1 only let a row remain that could go.

Defined cases: null or wordless text has an empty set and links with nothing; fewer words than
n make one n-gram; null ids get no component and are no one's least id (their rows still link);
rows with equal ids are separate members of their sets' classes and carry the component of
their own text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import discard, materialize, table
from sparklog.llm.graph import components
from sparklog.llm.wordhash import MULTIPLIER, mix, slices, word_hashes

#: Columns listed in one bucket, on average at most, and columns gathered before they are dealt.
BUCKET_COLUMNS, FLUSH_COLUMNS = 1 << 22, 1 << 21
#: Sets and n-grams in a chunk, on average at most; two chunks make a block.
CHUNK_SETS, CHUNK_GRAMS = 1000, 500_000
#: n-grams in more sets of a block than this are multiplied as dense columns, so many at once.
RARE, DENSE_COLUMNS = 32, 1024


def ngram_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z lower-cased."""
    for first, end, data, bounds in slices(column):
        words, _, _, at = word_hashes(data, bounds, lower=True)
        grams = words[: max(len(words) - n + 1, 0)].copy()
        for k in range(1, n):
            grams = mix(grams) * np.uint64(3) + words[k : len(words) - n + 1 + k]
        grams = mix(grams)
        for i in range(end - first):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                x = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    x = mix(x * np.uint64(5) + words[k : k + 1])
                yield x
            else:
                yield np.zeros(0, dtype=np.uint64)


def spare(size: int, percent: int) -> int:
    """How many of its n-grams a set may hold that a linked one does not."""
    return size * (100 - percent) // 100


def early(size: int, percent: int) -> int:
    """How many of its first n-grams are looked up; all but spare() of them must be found."""
    k = spare(size, percent)
    return k + (k + 1) // 2 + 1


def _spare(percent: int) -> Column:
    """spare() of the column n."""
    return F.expr(f"n * {100 - percent} div 100")


def name_of(x: np.ndarray) -> tuple[int, int]:
    """Two sums that name a set."""
    return int(np.add.reduce(mix(x))), int(np.add.reduce(mix(x ^ np.uint64(0x5851F42D4C957F2D))))


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each set, the same for equal sets."""
    names = np.array([(*name_of(x), len(x)) for x in sets], dtype=np.uint64).reshape(-1, 3)
    return mix(mix(mix(names[:, 0]) + names[:, 1]) + names[:, 2]).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *values])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.view(np.int64)))


def _name(n: int):
    """(id, th, node, n) of every row; node is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(ngram_sets(batch.column(2), n))
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes_of(sets), mask=sizes == 0), pa.array(sizes)], names=["id", "th", "node", "n"])

    return run


def _columns(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit number of n-grams, as one number."""
    spread = mix(grams ^ MULTIPLIER)
    return ((spread >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (spread & np.uint64(0xFFFFFFFF))


def _list_columns(n: int, percent: int, buckets: int):
    """(bucket, columns): the early columns of all sets, packed; a column is listed twice at most."""

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        columns, counts = np.unique(_columns(np.concatenate(held), buckets), return_counts=True)
        columns = np.repeat(columns, np.minimum(counts, 2))
        found, starts = np.unique(columns >> np.uint64(32), return_index=True)
        low = (columns & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        packed = [x.tobytes() for x in np.split(low, starts[1:])] if len(found) else []
        return pa.record_batch([pa.array(found.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "columns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for x in ngram_sets(batch.column(0), n):
                s = len(x)
                held.append(x[: early(s * 100 // percent, percent) + spare(s, percent)])
                total += len(held[-1])
                if total >= FLUSH_COLUMNS:
                    yield pack(held)
                    held, total = [], 0
        if total:
            yield pack(held)

    return run


def _listed_twice(bucket: pa.Table) -> pa.Table:
    number = bucket.column("bucket")[0].as_py()
    low = np.frombuffer(b"".join(x.as_py() for x in bucket.column("columns")), dtype=np.uint32)
    columns, counts = np.unique(low, return_counts=True)
    return pa.table({"col": pa.array((columns[counts > 1].astype(np.int64)) | (number << 32))})


def _look_up(n: int, percent: int, buckets: int):
    """(node, n, col) for the first columns of every set; once for equal sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for x in ngram_sets(batch.column(0), n) if len(x)]
            nodes, first = np.unique(nodes_of(sets), return_index=True)
            kept = [sets[i][: early(len(sets[i]), percent)] for i in first]
            sizes = np.array([len(sets[i]) for i in first], dtype=np.int64)
            times = np.array([len(x) for x in kept], dtype=np.int64)
            grams = np.concatenate([np.zeros(0, dtype=np.uint64), *kept])
            yield pa.record_batch(
                [pa.array(np.repeat(nodes, times)), pa.array(np.repeat(sizes, times)), pa.array(_columns(grams, buckets).view(np.int64))],
                names=["node", "n", "col"],
            )

    return run


def _collect_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(ngram_sets(batch.column(0), n))
            yield pa.record_batch([pa.array(nodes_of(sets)), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], names=["node", "n", "grams"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x) whose overlap reaches the bound that their sizes set."""
    sx = sets.select(F.col("node").alias("x"), F.col("grams").alias("gx"))
    sp = sets.select(F.col("node").alias("p"), F.col("grams").alias("gp"))
    nx, np_ = F.size("gx"), F.size("gp")
    near = pairs.join(sx, "x").join(sp, "p").where((100 * nx >= percent * np_) & (100 * np_ >= percent * nx))
    overlap = F.size(F.array_intersect("gx", "gp"))
    return near.where(100 * overlap >= percent * (nx + np_ - overlap)).select("p", "x")


def _named(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, th (the text's hash), node and n of every row, written."""
    source = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return materialize(source.mapInArrow(_name(n), source.select("id", "th").schema.add("node", "long").add("n", "long")), "rows")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles and component_id for every row of docs; t is percent / 100."""
    rows = _named(docs, key, text, n)
    labels = _labels(docs, rows, key, text, n, percent)
    least = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    # a label for each linked class; classes without one keep their own least id
    linked = labels.join(least, "node").groupBy("comp").agg(F.min("least").alias("component_id"))
    named = labels.join(linked, "comp").select("node", "component_id")
    named = least.join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(named, "node", "left")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Of every component one row: the least id, null first, and of equal ids the least text hash.

    Rows with an empty set all stay, equal ones once. Only rows found twice are compared by text.
    """
    rows = _named(docs, key, text, n)
    labels = _labels(docs, rows, key, text, n, percent)
    whole = rows.where("node is not null").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = whole.groupBy("comp").agg(F.min(F.struct("id", "th")).alias("first")).select("first.id", "first.th")
    first = first.unionByName(rows.where("node is null").select("id", "th")).distinct()
    times = rows.groupBy("id", "th").agg(F.count("*").alias("_times")).withColumnsRenamed({"id": "_id", "th": "_hash"})
    first = first.join(times, first["id"].eqNullSafe(times["_id"]) & (first["th"] == times["_hash"])).select("_id", "_hash", "_times")
    first = materialize(first, "first")
    columns = [F.col(f"_d.{c}").alias(c) for c in docs.columns]
    held = docs.select(F.struct(*docs.columns).alias("_d"), F.xxhash64(text).alias("_th"))
    held = held.join(first, held[f"_d.{key}"].eqNullSafe(first["_id"]) & (F.col("_th") == F.col("_hash")))
    once = held.where("_times = 1").select(*columns)
    return once.unionByName(held.where("_times > 1").select(*columns).dropDuplicates([key, text]))


def _labels(docs: DataFrame, rows: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """node, comp of every set that can link with another."""
    spark = docs.sparkSession
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_COLUMNS)
    texts = docs.select(F.col(text).alias("_text"))
    twice = texts.mapInArrow(_list_columns(n, percent, buckets), "bucket int, columns binary").groupBy("bucket").applyInArrow(_listed_twice, "col long")
    first = texts.mapInArrow(_look_up(n, percent, buckets), "node long, n long, col long")
    found = first.join(twice, "col").distinct().groupBy("node", "n").agg(F.count("*").alias("found"))
    k = _spare(percent)
    m = F.least(F.col("n"), k + F.floor((k + 1) / 2) + 1)
    remaining = materialize(found.where(F.col("found") >= F.greatest(m - k, F.lit(1))).select("node"), "remaining")
    one = rows.join(remaining, "node", "left_semi").groupBy("node").agg(F.min("id").alias("_id")).select("_id").distinct()
    # Where ids are not unique this brings texts of other classes along, which the nodes tell apart.
    held = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    held = held.join(one, held["_key"].eqNullSafe(one["_id"]), "left_semi").select("_text")
    collected = held.mapInArrow(_collect_sets(n), "node long, n long, grams array<long>").join(remaining, "node", "left_semi")
    sets = materialize(collected.groupBy("node").agg(F.first("n").alias("n"), F.first("grams").alias("grams")), "sets")
    members = materialize(_rarest(sets, percent), "members")
    labels = _link_members(sets, members, percent)
    discard(remaining, sets, members)
    return labels


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, node): the rarest columns of each set that others list as well."""
    each = sets.select("node", "n", F.explode("grams").alias("sig"))
    counted = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(counted, "sig").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("cols"))
    wanted = _spare(percent) + 1 - (F.col("n") - F.size("cols"))  # columns of one row come first
    kept = ranked.where(wanted > 0).select("node", F.explode(F.slice("cols", F.lit(1), wanted.cast("int"))).alias("c"))
    kept = kept.select("c.sig", "node")
    shared = kept.groupBy("sig").agg(F.count("*").alias("rows")).where("rows > 1").select("sig")
    return kept.join(shared, "sig")


def _link_members(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """node, comp of all members of shared columns."""
    nodes = materialize(members.select("node").distinct(), "nodes")
    if nodes.isEmpty():
        return nodes.withColumn("comp", F.col("node"))
    sizes = members.groupBy("sig").agg(F.count("*").alias("size"))
    degree = members.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("degree"))
    rank = F.struct(-F.col("degree"), F.col("node"))
    ranked = members.join(degree, "node")
    leaders = ranked.groupBy("sig").agg(F.min(rank).alias("leader"))
    central = ranked.join(leaders, "sig").groupBy("node").agg(F.min("leader").alias("leader"))
    pairs = central.select(F.col("leader.node").alias("p"), F.col("node").alias("x")).where("p != x")
    links = materialize(_linked(pairs, sets, percent), "links")
    labels = components(links, nodes, "p", "x")
    state = members.join(labels, "node").select("sig", "node", "comp")
    parts = state.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("hub"))
    open_ = parts.where("lo != hi").select("sig", "hub")
    spokes = state.join(open_, "sig").select(F.col("node").alias("p"), F.col("hub").alias("x"))
    held = materialize(spokes.distinct(), "spokes")
    if held.isEmpty():
        return labels
    clusters = components(held, held.select("p"), "p", "x").withColumnRenamed("comp", "cluster")
    forest = materialize(_block_products(clusters.join(labels, "node"), sets, percent), "forest")
    out = components(links.unionByName(forest), nodes, "p", "x")
    discard(links, forest, held, labels, clusters)
    return out


def _block_products(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(p, x), a forest of the links between different parts of each cluster, from (node, cluster, comp)."""
    sized = nodes.join(sets.select("node", "n"), "node")
    by_part = sized.groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("g"))
    # a large part has chunks of its own; the small ones of a cluster share theirs
    part = F.when(F.col("m") >= CHUNK_SETS // 2, F.col("comp"))
    by_chunk = by_part.groupBy("cluster", part.alias("part")).agg(F.sum("m").alias("m"), F.sum("g").alias("g"))
    chunks = by_chunk.select(
        "cluster", "part", F.ceil(F.greatest(F.col("m") / CHUNK_SETS, F.col("g") / CHUNK_GRAMS)).cast("long").alias("chunks")
    )
    of_part = by_part.select(F.col("cluster").alias("c"), F.col("comp").alias("q"), part.alias("part"))
    same = lambda a, b: (a["cluster"] == b["cluster"]) & a["part"].eqNullSafe(b["part"])
    placed = sized.join(of_part, (sized["cluster"] == of_part["c"]) & (sized["comp"] == of_part["q"])).drop("c", "q")
    placed = placed.join(chunks, same(placed, chunks)).select(
        placed["cluster"], placed["part"], "node", "n", F.pmod(F.xxhash64("node"), "chunks").alias("k")
    )
    placed = materialize(placed, "placed")
    chunk = F.struct("part", "k")
    listed = placed.groupBy("cluster", "part", "k").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = listed.select("cluster", chunk.alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    pairs = left.join(listed.select("cluster", chunk.alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high")), "cluster").where(
        (F.col("a") <= F.col("b"))
        & (F.col("a.part").isNull() | ~F.col("a.part").eqNullSafe(F.col("b.part")))
        & (100 * F.col("a_high") >= percent * F.col("b_low"))
        & (100 * F.col("b_high") >= percent * F.col("a_low"))
    )
    pairs = pairs.withColumn("block", F.xxhash64("cluster", "a", "b"))
    sides = pairs.select("cluster", "block", F.explode(F.array_distinct(F.array("a", "b"))).alias("s")).select(
        F.col("cluster").alias("c"), "block", F.col("s.part").alias("sp"), F.col("s.k").alias("sk")
    )
    on = (placed["cluster"] == sides["c"]) & placed["part"].eqNullSafe(sides["sp"]) & (placed["k"] == sides["sk"])
    blocks = placed.join(sides, on).select("block", "node").join(sets.select("node", "grams"), "node")
    return blocks.groupBy("block").applyInArrow(_product(percent), "p long, x long")


def _product(percent: int):
    def run(block: pa.Table) -> pa.Table:
        nodes = block.column("node").to_numpy()
        lists = block.column("grams").combine_chunks()
        grams = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        overlap = overlaps(np.repeat(np.arange(len(nodes)), sizes), grams, len(nodes))
        both = sizes[:, None] + sizes[None, :]
        linked = (100 + percent) * overlap.astype(np.int64) >= percent * both
        root = np.full(len(nodes), -1)
        for i in range(len(nodes)):
            if root[i] < 0:
                front = np.array([i])
                while len(front):
                    root[front] = i
                    front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
        return pa.table({"p": nodes[root], "x": nodes}).filter(pa.array(nodes[root] != nodes))

    return run


def overlaps(rows: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """The n x n matrix of the numbers of common grams; rows names the set of each gram."""
    _, columns, counts = np.unique(grams, return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float32)
    frequent = np.flatnonzero(counts > RARE)
    number = np.full(len(counts), -1)
    number[frequent] = np.arange(len(frequent))
    dense = number[columns] >= 0
    for first in range(0, len(frequent), DENSE_COLUMNS):
        block = np.zeros((n, min(DENSE_COLUMNS, len(frequent) - first)), dtype=np.float32)
        here = dense & (number[columns] >= first) & (number[columns] < first + block.shape[1])
        block[rows[here], number[columns[here]] - first] = 1
        out += block @ block.T
    rare = ~dense & (counts[columns] > 1)
    order = np.argsort(columns[rare], kind="stable")
    r, c = rows[rare][order], columns[rare][order]
    for shift in range(1, RARE):
        same = np.flatnonzero(c[shift:] == c[:-shift])
        if not len(same):
            break
        found = np.bincount(r[same] * n + r[same + shift], minlength=n * n).reshape(n, n)
        out += found
        out += found.T
    return out


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ')
                               ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 90 * (na.n + nb.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) m ON m.a = w.doc_id
"""
