"""The packing plan against best fit decreasing one piece at a time."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from sparklog.llm import packing

SKEWED = [
    ({500: 4}, 2048),
    ({682: 10_001}, 2048),
    ({1: 5_000, 3: 7, 900: 3_000}, 2048),
    ({1: 10}, 12),
    ({7: 50, 5: 1, 4: 33, 3: 2, 1: 90}, 12),
]


def one_at_a_time(counts, capacity):
    """Sequences that best fit decreasing opens."""
    rooms = [0] * (capacity + 1)
    for x in range(capacity, 0, -1):
        for _ in range(int(counts[x])):
            room = next((r for r in range(x, capacity + 1) if rooms[r]), None)
            if room is None:
                room = capacity
            else:
                rooms[room] -= 1
            rooms[room - x] += 1
    return sum(rooms)


def as_array(counts, capacity):
    out = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in counts.items():
        out[x] = n
    return out


def some_counts():
    rng = random.Random(8)
    yield from SKEWED
    for _ in range(60):
        capacity = rng.choice([12, 40, 100])
        yield {rng.randint(1, capacity): rng.choice([1, 2, 5, 200]) for _ in range(rng.randint(1, 9))}, capacity


def test_best_fit_is_best_fit():
    for counts, capacity in some_counts():
        array = as_array(counts, capacity)
        groups = packing.best_fit(array, capacity)
        placed = defaultdict(int)
        for held, times in groups:
            assert sum(x * each for x, each in held) <= capacity
            for x, each in held:
                placed[x] += each * times
        assert placed == counts
        assert sum(times for _, times in groups) == one_at_a_time(array, capacity), (counts, capacity)


def test_plan_places_each_piece_once_and_leaves_at_most_one_half_empty():
    for counts, capacity in some_counts():
        ranks, used = defaultdict(list), defaultdict(list)
        for x, first, last, each, sequence, offset in packing.plan_runs(counts, capacity):
            for rank in range(first, last + 1):
                ranks[x].append(rank)
                used[sequence + (rank - first) // each].append((offset + x * ((rank - first) % each), x))
        assert {x: list(range(n)) for x, n in counts.items()} == {x: sorted(r) for x, r in ranks.items()}
        for held in used.values():
            end = 0
            for offset, x in sorted(held):
                assert offset == end
                end += x
            assert end <= capacity
        assert len(used) <= -(-2 * sum(x * n for x, n in counts.items()) // capacity), (counts, capacity)


@pytest.mark.parametrize("n", [4, 301])
def test_equal_texts_share_sequences(spark, n):
    docs = spark.createDataFrame([(i, "one two three four") for i in range(n)], "doc_id long, text string")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 64).collect()
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    length = out[0]["length"]
    assert len(out) == n and len(used) == -(-n // (64 // length))
    for held in used.values():
        assert sorted(held) == [(length * k, length) for k in range(len(held))]
