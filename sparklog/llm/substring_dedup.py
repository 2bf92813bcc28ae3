"""Op 7: remove every word that lies in a run of ``run`` words found elsewhere as well.

A suffix automaton of a reference shard, with the number of places of each state, tells for every
position of a streamed text whether the last ``run`` words occur twice or more. One automaton of
everything would grow with the corpus, and sending every shard to every document would cost the
square of it, so shards are cut by content and each meets only the text that can match it:

1. Every window of ``run`` words has a minimizer, the least hash of its runs of GRAM words.
   Consecutive windows with one minimizer make a segment, of as many windows as can hold one
   place of it. Equal windows have equal minimizers, so a window repeats only among the segments
   of its minimizer. A minimizer with one segment that holds it in one place has no repeats.
2. The segments of all other minimizers are references, pre-aggregated by content with the number
   of their places. They are dealt by minimizer to shards of bounded size. A minimizer with more
   words than that is dealt by its windows' two least hashes, then four and so on; with all
   hashes of a window, equal ones are one content, so that the parts become small.
3. Each shard's automaton gets its references with their numbers, and the matching statistics of
   each content give the windows that occur twice or more. A minimizer whose segments are n > 1
   places of one content needs none: its automaton were a chain in which every state counts n.
4. Spans go to the places of their content, and are merged and removed.

Defined cases: null text has no words; fewer than ``run`` words: nothing is removed; the id may
be null or repeat: each row is a document, so two equal rows with ``run`` words or more are
copies and lose all words; an empty table gives an empty table; other columns are ignored.
Contents are told apart by their minimizer and a 64-bit hash, words by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import discard, materialize, same_row, table
from sparklog.llm.wordhash import INVERSE, mix, powers, rolled, slices, word_hashes

#: Words in the runs whose least hash is a window's minimizer.
GRAM = 8
#: Words of a reference shard, on average, and of one key in it at most.
SHARD_WORDS, KEY_WORDS = 20_000, 40_000
#: A minimizer of more than one segment in so many is hot; fewer minimizers than this can be.
HOT_SHARE = 1000


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def segments(words: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """Minimizer, content hash, first and last window of each segment of the words, and whether
    the segment holds its minimizer in two places."""
    if len(words) < run:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=bool),)
    grams, most = rolled(words, GRAM), run - GRAM + 1
    least = sliding_min(grams, most)
    n = len(least)
    valid = doc[:n] == doc[run - 1 :]
    joined = valid[1:] & valid[:-1] & (least[1:] == least[:-1]) & (doc[1:n] == doc[: n - 1])
    first = np.flatnonzero(valid & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(valid & ~np.concatenate([joined, [False]]))
    parts = -(-(last - first + 1) // most)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first, last = np.repeat(first, parts) + nth * most, np.repeat(last, parts)
    last = np.minimum(last, first + most - 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * powers(len(words)), dtype=np.uint64)])
    content = mix((sums[last + run] - sums[first]) * powers(n, INVERSE)[first] + (last - first).astype(np.uint64))
    held = last - first + most
    starts = np.cumsum(held) - held
    at = np.arange(int(held.sum())) - np.repeat(starts - first, held)
    places = np.add.reduceat((grams[at] == np.repeat(least[first], held)).astype(np.int64), starts) if len(first) else held
    return least[first], content, first, last, places > 1


def _read(run: int):
    """(id, th, m, s, a, b, twice) of every segment."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, bounds in slices(batch.column(2)):
                words, _, _, at = word_hashes(data, bounds)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                m, s, first, last, twice = segments(words, doc, run)
                row = doc[first] if len(first) else first
                take = pa.array(row + start)
                a, b = ((x - at[row]).astype(np.int32) for x in (first, last))
                columns = [batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, (m.view(np.int64), s.view(np.int64), a, b, twice))]
                yield pa.record_batch(columns, names=["id", "th", "m", "s", "a", "b", "twice"])

    return go


_REFERENCE = "key long, t long, n long, words array<long>"


def _references(run: int):
    """(key, t, n, words) of the segments that each text lends as references."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lent = batch.column(1).to_pylist()
            out = []
            for start, end, data, bounds in slices(batch.column(0)):
                words, _, _, at = word_hashes(data, bounds)
                words = words.view(np.int64)
                for i in range(start, end):
                    w = words[at[i - start] : at[i - start + 1]]
                    out += [(x["m"], x["s"], x["n"], w[x["a"] : x["b"] + run]) for x in lent[i]]
            yield pa.record_batch(
                [*(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                names=["key", "t", "n", "words"],
            )

    return go


def _recut(run: int, least: int):
    """(key, t, shift, key2, t2, n, words): each content in runs of windows with equal ``least`` hashes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, t, n, held in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = np.array(held, dtype=np.int64)
                grams = rolled(words.view(np.uint64), GRAM)
                names = [mix(np.unique(grams[i : i + run - GRAM + 1])[:least]) for i in range(len(words) - run + 1)]
                names = [int(np.add.reduce(mix(x + np.arange(len(x), dtype=np.uint64)))) for x in names]
                first = 0
                for i in range(1, len(names) + 1):
                    if i == len(names) or names[i] != names[first]:
                        part = words[first : i + run - 1]
                        t2 = rolled(part.view(np.uint64), len(part)).view(np.int64)[0]
                        out.append((key, t, first, np.uint64(names[first]).astype(np.int64), t2, n, part))
                        first = i
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["key", "t", "shift", "key2", "t2", "n", "words"])

    return go


class SuffixAutomaton:
    """The suffix automaton of several sequences, with how often each state's strings occur."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append(dict(self.next[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p reaches by c, made to hold nothing longer."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], times: int) -> None:
        last = 0
        for c in words:
            if c in self.next[last]:
                last = self._split(last, c)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                self.link[new] = self._split(p, c) if p >= 0 else 0
                last = new
            self.count[last] += times

    def finish(self) -> None:
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[int], run: int) -> list[int]:
        """The starts of the windows of ``run`` words that occur twice or more."""
        out, v, matched = [], 0, 0
        for i, c in enumerate(words):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            while self.length[self.link[v]] >= run:
                v = self.link[v]
                matched = self.length[v]
            if matched >= run and self.count[v] > 1:
                out.append(i - run + 1)
        return out


def _match(run: int):
    """A reference shard's automaton, against its contents: (key, t, hits), hits in runs (a, b)."""

    def go(shard: pa.Table) -> pa.Table:
        rows = {(x["key"], x["t"]): x for x in shard.select(["key", "t", "n", "words"]).to_pylist()}
        automaton = SuffixAutomaton()
        for x in rows.values():
            automaton.add(x["words"], x["n"])
        automaton.finish()
        found = []
        for (key, t), x in rows.items():
            hits = automaton.repeated(x["words"], run)
            runs = []
            for h in hits:
                if runs and runs[-1]["b"] == h - 1:
                    runs[-1]["b"] = h
                else:
                    runs.append({"a": h, "b": h})
            if runs:
                found.append((key, t, runs))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        return pa.table({c: pa.array([x[i] for x in found], kinds[i]) for i, c in enumerate(("key", "t", "hits"))})

    return go


def _remove(run: int):
    """n_words, n_removed and the kept text from (id, text, spans of windows)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer()
                words = raw.to_pybytes().split() if raw else []
                n.append(len(words))
                if spans.is_valid and len(spans):
                    delta = np.zeros(len(words) + 1, dtype=np.int64)
                    for x in spans.as_py():
                        delta[x["a"]] += 1
                        delta[x["b"] + run] -= 1
                    stays = np.cumsum(delta[:-1]) == 0
                    words = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return go


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 35) -> DataFrame:
    """key, n_words, n_removed and kept, the words that stay, joined by single spaces."""
    if run < GRAM:
        raise ValueError(f"run must be {GRAM} words or more")
    source = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    segs = materialize(source.mapInArrow(_read(run), f"id {id_type}, th long, m long, s long, a int, b int, twice boolean"), "segments")
    counted = segs.groupBy("m").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    shared = materialize(counted.where("n > 1 or twice").select("m", "n", F.expr("n > 1 and lo = hi").alias("chain")), "shared")
    places = materialize(_places(segs, shared), "places")
    discard(segs, shared)
    contents = places.where("not chain").groupBy("m", "s").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "a", "b")).alias("lender"))
    lent = contents.select("lender.id", "lender.th", F.struct("lender.a", "lender.b", "m", "s", "n").alias("x"))
    lent = materialize(lent.groupBy("id", "th").agg(F.collect_list("x").alias("lent")), "lent")
    lenders = source.join(lent, same_row(source, lent, ["id", "th"])).select("text", "lent")
    references = materialize(lenders.mapInArrow(_references(run), _REFERENCE), "references")
    hits = _hits(references, run)
    at = places.where("not chain").join(hits, (places["m"] == hits["key"]) & (places["s"] == hits["t"])).select("id", "th", "a", "hits")
    moved = F.transform("hits", lambda h: F.struct((h["a"] + F.col("a")).alias("a"), (h["b"] + F.col("a")).alias("b")))
    whole = places.where("chain").select("id", "th", F.array(F.struct("a", "b")).alias("runs"))
    spans = at.select("id", "th", moved.alias("runs")).unionByName(whole).groupBy("id", "th").agg(F.flatten(F.collect_list("runs")).alias("spans"))
    joined = source.join(spans, same_row(source, spans, ["id", "th"]), "left").select(source["id"], "text", "spans")
    done = joined.mapInArrow(_remove(run), f"id {id_type}, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("id", key)


def _places(segs: DataFrame, shared: DataFrame) -> DataFrame:
    """The segments of the shared minimizers, with chain.

    Hot minimizers are broadcast, fewer than HOT_SHARE whatever the input, so that the segments of
    one don't meet in one task; the others meet theirs by a shuffle.
    """
    least = segs.count() // HOT_SHARE
    hot = shared.where(F.col("n") > least).select("m", F.col("chain").alias("hot"))
    rest = shared.where(F.col("n") <= least).select("m", "chain")
    marked = segs.drop("twice").join(F.broadcast(hot), "m", "left")
    found = marked.where("hot is not null").withColumnRenamed("hot", "chain")
    return found.unionByName(marked.where("hot is null").drop("hot").join(rest, "m"))


def _hits(references: DataFrame, run: int, least: int = 1) -> DataFrame:
    """(key, t, hits): the repeated windows of each content, from its shard's automaton."""
    sizes = references.groupBy("key").agg(F.sum(F.size("words")).alias("size"))
    large = sizes.where(F.col("size") > KEY_WORDS).select("key") if least < run - GRAM + 1 else None
    if large is not None and not large.isEmpty():
        large = materialize(large, "large")
        cuts = references.join(large, "key", "left_semi").select("key", "t", "n", "words")
        cuts = materialize(cuts.mapInArrow(_recut(run, 2 * least), "key long, t long, shift int, key2 long, t2 long, n long, words array<long>"), "cuts")
        parts = cuts.groupBy("key2", "t2").agg(F.sum("n").alias("n"), F.first("words").alias("words")).withColumnsRenamed({"key2": "key", "t2": "t"})
        found = _hits(materialize(parts, "parts"), run, 2 * least).withColumnsRenamed({"key": "key2", "t": "t2"})
        moved = F.transform("hits", lambda h: F.struct((h["a"] + F.col("shift")).alias("a"), (h["b"] + F.col("shift")).alias("b")))
        deep = cuts.join(found, ["key2", "t2"]).groupBy("key", "t").agg(F.flatten(F.collect_list(moved)).alias("hits"))
        references = references.join(large, "key", "left_anti")
    else:
        deep = None
    total = references.agg(F.sum(F.size("words"))).first()[0] or 0
    dealt = references.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, int(total) // SHARD_WORDS))))
    found = dealt.groupBy("shard").applyInArrow(_match(run), "key long, t long, hits array<struct<a:int,b:int>>")
    return materialize(found if deep is None else found.unionByName(deep), "hits")


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), run=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), x AS (
  SELECT doc_id, i, hash(list_slice(words, i, i + 34)) AS h, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS m
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h, m) AS n FROM x) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, 35) t(k)
), g AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), k AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
         CASE WHEN gone IS NULL THEN words
              ELSE (SELECT coalesce(list(w.words[j] ORDER BY j), []) FROM (SELECT unnest(list_filter(range(1, len(w.words) + 1), lambda z: NOT list_contains(g.gone, z))) AS j)) END AS kept
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
