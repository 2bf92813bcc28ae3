"""The pipeline's stages against plain versions of them, one after the other, on small documents."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest
from sparklog.llm import ngram_join

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, keep_me string, _th int, n_lines int"


def make(seed=1):
    draw = random.Random(seed)
    say = lambda n: " ".join(draw.choice(VOCABULARY) for _ in range(n))
    page = lambda n: "\n".join(say(9) for _ in range(n))
    shared = page(4)
    base = [page(12) for _ in range(12)]
    texts = [*base, base[0], base[1].replace("v1", "v2", 1), f"{base[2]}\n{shared}", f"{base[3]}\n{shared}", f"{page(6)}\n{ITEM}\n{page(6)}"]
    texts += [None, "", "short", "#$%& " * 60 + page(8), "again and again " * 40, page(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(0, texts[1]), (0, texts[0]), (None, page(12)), (None, texts[4])]
    return [(i, t, draw.choice(["en", None]), draw.choice(["web", "book", None]), len(t) if t is not None else None, f"k{k}", k, None) for k, (i, t) in enumerate(rows)]


VOCABULARY = [f"v{i}" for i in range(4000)]
ITEM = " ".join(f"item{i}" for i in range(30))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(make(), COLUMNS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "too short")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    # quality
    before = rows_of(docs)
    kept = stages["quality"](spark, docs, folder)
    assert kept.columns == columns
    verdicts = brute.quality_verdicts([(r["lang"], r["source"], r["text"]) for r in before])
    key = lambda r: tuple((c, r[c]) for c in columns)
    assert sorted(map(str, map(key, rows_of(kept)))) == sorted(str(key(r)) for r, good in zip(before, verdicts, strict=True) if good)
    assert 0 < sum(verdicts) < len(before)
    docs = spark.createDataFrame(rows_of(kept), kept.schema)
    # lines: rows in the order of id (null first) and text hash; equal rows are one document
    before = rows_of(docs)
    got = stages["lines"](spark, docs, folder)
    assert got.columns == columns
    hashes = {r["t"]: r["h"] for r in docs.selectExpr("text t", "xxhash64(text) h").collect()}
    order = {(r["doc_id"], r["text"]) for r in before}
    order = sorted(order, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    cleaned = brute.dedup_lines([(k, t) for k, (_, t) in enumerate(order)])
    cleaned = {x: cleaned[k] for k, x in enumerate(order)}
    wanted = [r | {"text": cleaned[r["doc_id"], r["text"]]} for r in before]
    wanted = [r | {"n_chars": len(r["text"])} for r in wanted if brute.words(r["text"])]
    assert sorted(map(str, map(key, rows_of(got)))) == sorted(str(key(r)) for r in wanted)
    docs = spark.createDataFrame(rows_of(got), got.schema)
    # similar
    before = rows_of(docs)
    got = stages["similar"](spark, docs, folder)
    assert got.columns == columns
    hashes = {r["t"]: r["h"] for r in docs.selectExpr("text t", "xxhash64(text) h").collect()}
    order = sorted({(r["doc_id"], r["text"]) for r in before}, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    group = brute.components([(k, t) for k, (_, t) in enumerate(order)], 5, 80)
    first = {order[k] for k, (_, least) in group.items() if k == least}
    assert sorted(str((r["doc_id"], r["text"])) for r in rows_of(got)) == sorted(map(str, first))
    docs = spark.createDataFrame(rows_of(got), got.schema)
    # leaks
    before = rows_of(docs)
    got = stages["leaks"](spark, docs, folder)
    assert got.columns == columns
    leaks = brute.leaks([(k, r["text"]) for k, r in enumerate(before)], [(1, ITEM), (3, "too short")])
    wanted = [r for k, r in enumerate(before) if leaks.get((k, 1), 0) < 0.8]
    assert sorted(map(str, map(key, rows_of(got)))) == sorted(str(key(r)) for r in wanted)
    assert len(wanted) == len(before) - 1
    # packing, and run() as a whole
    packed = rows_of(stages["packing"](spark, got, folder))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in wanted}
    whole = rows_of(corpus_pipeline.run(spark, folder))
    content = lambda rows: sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows)
    assert content(whole) == content(packed)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_copies_under_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(0, a), (1, a), (1, b), (1, b), (2, None), (2, None), (3, "")], "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"] or "") for r in ngram_join.keep_one(docs).collect())
    assert kept == [(0, a), (1, b), (2, ""), (3, "")]
