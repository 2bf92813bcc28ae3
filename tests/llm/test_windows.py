"""Leaks against all windows of the item's size."""

from __future__ import annotations

from sparklog.llm import decontam


def leaked(doc, item):
    """Whether a window has a Jaccard similarity of 0.8; shingles of disjoint items weigh alike."""
    cut = lambda words: [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    own, held = cut(item), cut(doc)
    for at in range(len(held)):
        window = set(held[at : at + len(own)])
        if 10 * len(window & set(own)) >= 8 * len(window | set(own)):
            return True
    return False


def test_leaks_are_those_of_all_windows(spark):
    items = [[f"i{k}w{j}" for j in range(size)] for k, size in enumerate((40, 60))]
    rows = []
    for k, item in enumerate(items):
        for m in range(1, 10):
            more = [f"m{k}x{m}x{j}" for j in range(30)]
            rows += [item[m:], item[:-m], [*item[m:], *more], [*more, *item[:-m]]]
            rows += [[*item[:20], *more[:m], *item[20:]], [*more, *item[:20], *more[:m], *item[20 + m :], *more]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    wanted = {(i, k) for i, w in enumerate(rows) for k, item in enumerate(items) if leaked(w, item)}
    assert len(wanted) not in (0, len(rows))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == wanted, (sorted(wanted - got), sorted(got - wanted))
