"""Op 8: pack documents into as few sequences of bounded length as it can.

Documents become token ids, then an end id, and are cut only if longer than a sequence. What
packing needs to know is how many pieces there are of each length, a table with as many rows as
a sequence has tokens, however large the corpus. On that table:

1. *Dominance reduction* (Martello and Toth). For a piece j, from the longest down, a set with j
   that dominates every other set with j is fixed for good: j alone if nothing fits beside it; j
   and the longest k that fits, if they fill the sequence or if no two pieces fit beside j; j, k
   and the longest b beside them, if no three pieces fit beside j and no two pieces longer than b
   do. Counts are fixed many at a time.
2. *Best fit*, longest first, for the rest: into the fullest open sequence with room.

The result is runs: the pieces of a length with ranks from r go to sequences from s, n to each,
from offset o. Pieces are ranked within their length without a task holding a whole length, and find their
run by a join with the table of runs, whose size the sequence's length bounds.

Tokenizing: this tokenizer drops white space and merges nothing across it, so a text's ids are
those of its words in turn, and each worker looks up words that it has met before.

Defined cases: null text is empty; an empty text is its end id alone; ids of documents may be
null or repeat, each row is packed; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import gapless_rank, materialize, table, with_row_position

#: Words that a worker remembers, and the longest that it does.
CACHE_WORDS, CACHE_BYTES = 400_000, 64
#: Rows of the table of runs up to which it is broadcast.
BROADCAST_RUNS = 200_000

#: Words of these letters are in the normal form already and one pre-token each.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class WordTokenizer:
    """Ids of words as little-endian 32-bit numbers, remembered; for tokenizers that lower-case
    letters and drop white space.

    Plain words go to the model alone, a final full stop or comma apart; all others through the
    whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[bytes, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.ends = {bytes([c]): self.encode([bytes([c])])[0] for c in b".,"}
        probe = ["Über", "x.", "don't", "ñ,"]
        if b"".join(self.ids({w.encode().lower() for w in probe})[w.encode().lower()] for w in probe) != self.encode([" \n".join(probe).encode()])[0]:
            raise ValueError(f"{path} does not tokenize words by themselves")

    def encode(self, words: list[bytes]) -> list[bytes]:
        coded = self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def plain(self, word: bytes) -> bytes | None:
        end = self.ends.get(word[-1:]) if len(word) > 1 and word[-2] in _LETTERS else None
        stem = word[:-1] if end else word
        if not _PLAIN.fullmatch(stem.decode("utf-8", "replace")):
            return None
        tokens = self.model.tokenize(stem.decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes() + (end or b"")

    def ids(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of at least these words."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(words)
        out, slow = self.known, []
        for w in new:
            ids = self.plain(w) if len(w) <= CACHE_BYTES else None
            if ids is None:
                slow.append(w)
            else:
                out[w] = ids
        long = {}
        for w, ids in zip(slow, self.encode(slow), strict=True):
            (out if len(w) <= CACHE_BYTES else long)[w] = ids
        return out | long if long else out


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _cut(path: str, capacity: int, end_id: int):
    """(id, piece, start, length, ids_crc32) of every piece."""
    end = array("I", [end_id]).tobytes()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            texts = batch.column(1)
            for first in range(0, len(texts), 200):
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.slice(first, 200)]
                # special tokens, which begin so, are told by their case; else case doesn't matter
                split = [(t if b"<|" in t else t.lower()).split() for t in raw]
                known = tokenizer.ids(set().union(*split))
                rows = []
                for i, doc in enumerate(split):
                    ids = b"".join(map(known.__getitem__, doc)) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((first + i, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(columns[0])), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return go


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, taking them from counts[length]; returns (lengths, how many)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def least(n: int, above: int = 0) -> list[int]:
        """The n shortest pieces longer than ``above``, with multiplicity."""
        out: list[int] = []
        for x in np.flatnonzero(counts[above + 1 :]) + above + 1:
            out += [int(x)] * min(n - len(out), int(counts[x]))
            if len(out) == n:
                break
        return out

    def longest(room: int) -> int:
        there = np.flatnonzero(counts[: max(room, 0) + 1])
        return int(there[-1]) if len(there) else 0

    def fix(*lengths: int) -> None:
        times = min(int(counts[x]) // lengths.count(x) for x in lengths)
        for x in lengths:
            counts[x] -= times
        fixed.append((lengths, times))

    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            counts[j] -= 1
            k = longest(room)
            two, three = least(2), least(3)
            one_fits = len(two) < 2 or sum(two) > room
            b = 0
            if k and not one_fits and (len(three) < 3 or sum(three) > room):
                counts[k] -= 1
                b = longest(room - k)
                counts[k] += 1
                longer = least(2, b)
                if len(longer) == 2 and sum(longer) <= room:
                    b = 0
            counts[j] += 1
            if not k:
                fix(j)
            elif k == room or one_fits:
                fix(j, k)
            elif b:
                fix(j, k, b)
            else:
                break
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit decreasing of what counts[length] holds, many equal sequences at a time.

    Returns (((length, how many in each), ...), sequences). A sequence that takes a piece is the
    fullest with room for the next of that length too, so it is filled up before another one is.
    """
    open_: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(capacity + 1)]
    for x in range(capacity, 0, -1):
        left = int(counts[x])
        while left:
            room = next((r for r in range(x, capacity + 1) if open_[r]), None)
            held, times = open_[room].pop() if room is not None else ((), left)
            room = capacity if room is None else room
            each = room // x
            full = min(times, left // each)
            left -= full * each
            last = left if full < times else 0  # a sequence that the rest does not fill
            left -= last
            if full:
                open_[room - each * x].append(((*held, (x, each)), full))
            if last:
                open_[room - last * x].append(((*held, (x, last)), 1))
            if held and (unused := times - full - bool(last)):
                open_[room].append((held, unused))
    return [group for groups in open_ for group in groups]


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, how many in each sequence, first sequence, offset) of every run."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    groups = [(tuple(Counter(lengths).items()), times) for lengths, times in reduce_by_dominance(left, capacity)]
    groups += best_fit(left, capacity)
    ranks: dict[int, int] = {}
    runs, sequence = [], 0
    for held, times in groups:
        offset = 0
        for x, each in held:
            rank = ranks.get(x, 0)
            runs.append((x, rank, rank + times * each - 1, each, sequence, offset))
            ranks[x] = rank + times * each
            offset += x * each
        sequence += times
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    pieces = source.mapInArrow(_cut(tokenizer, capacity, end_id), f"id {id_type}, piece int, start long, length long, ids_crc32 long")
    stored = materialize(with_row_position(pieces), "pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = spark.createDataFrame(
        plan_runs(counts, capacity), "run_length long, first_rank long, last_rank long, each long, first_sequence long, first_offset long"
    )
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    ranked = gapless_rank(stored, ["length"], "rank")
    nth = F.col("rank") - F.col("first_rank")
    on = (F.col("length") == F.col("run_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    return ranked.join(runs, on).select(
        F.col("id").alias(key),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + F.col("length") * (nth % F.col("each"))).alias("offset"),
    )


def op8_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
