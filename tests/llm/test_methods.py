"""What each method adds to its operator's base: verdicts, windows, draws, votes, orders."""

from __future__ import annotations

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sparklog.llm import chat, decontam, line_dedup, pii, quality, sharding
from sparklog.llm.secret_scan import find_secrets

SF = "/root/testdata/sf0.001"


# -- op 1


def planted(seed=3):
    """Items, and documents that hold them whole, edited, with a word more, cut, or in another order."""
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(14, 60)))) for i in range(30)]
    docs = []
    for _, text in items:
        w = text.split()
        at, half, third, tenth = draw.randrange(len(w)), len(w) // 2, len(w) // 3, max(1, len(w) // 10)
        forms = {
            "whole": w, "edited": [*w[:at], "other", *w[at + 1 :]], "longer": [*w[:at], "one", *w[at:]], "front cut": w[tenth:], "end cut": w[:-tenth],
            "halves": w[half:] + w[:half], "thirds": w[2 * third :] + w[:third] + w[third : 2 * third], "part": w[:half],
        }
        for form in forms.values():
            around = [[draw.choice(vocabulary) for _ in range(draw.choice([0, 40]))] for _ in range(2)]
            docs.append((len(docs), " ".join(around[0] + form + around[1])))
    return items, docs


def test_decontamination_against_all_windows(spark):
    items, docs = planted()
    exact = brute.leaks(docs, items)
    wanted = {pair: s for pair, s in exact.items() if s >= 0.8}
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    assert set(got) <= set(wanted)
    assert len(got) >= 0.97 * len(wanted) > 100
    close = [pair for pair, s in wanted.items() if s >= 0.85]
    assert all(pair in got for pair in close)
    assert all(got[pair] <= wanted[pair] + 1e-6 for pair in got)


def test_swapped_halves_are_found(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(120))) for i in range(12)]
    halves = [(i, " ".join(t.split()[60:] + t.split()[:60])) for i, t in items]
    found = decontam.find_leaks(spark.createDataFrame(halves, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i, i) for i in range(12)}


def test_decontamination_of_odd_rows(spark):
    item = " ".join(f"item{i}" for i in range(30))
    long = " ".join(f"w{i % 900}" for i in range(30_000))
    rows = [(1, f"{long} {item} {long}", 0, "a"), (1, long, 0, "b"), (None, item, 1, None), (2, None, 2, None), (3, "", 3, None), (4, item, 4, None), (4, item, 4, None), (5, f"{item} {item}", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _th long, _hash string")
    items = spark.createDataFrame([(7, item, 1), (8, item, 2), (9, None, 3)], "item_id long, text string, item long")
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["_th"], r["_hash"]) for r in kept.collect()) == [(1, 0, "b"), (2, 2, None), (3, 3, None)]
    found = decontam.find_leaks(docs, items)
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found.collect()) == [(i, k) for i in (0, 1, 4, 5) for k in (7, 8)]


# -- op 2


def test_verdicts_against_plain_fences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    rows = docs.select("doc_id", "lang", "source", "text").collect()
    wanted = brute.quality_verdicts([(r["lang"], r["source"], r["text"]) for r in rows])
    assert out == {r["doc_id"]: v for r, v in zip(rows, wanted, strict=True)}


def test_a_group_moves_from_its_parents_cutoffs_to_its_own(spark):
    """Line rates of a source lie far above those of its language; the more documents, the more it counts."""

    def most(n):
        rows = [("en", "web", "line_rate", 20 + i % 5, 400) for i in range(5)] + [("en", "poems", "line_rate", 100 + i, n) for i in range(5)]
        sketches = spark.createDataFrame(rows, "lang string, source string, rate string, bucket long, n long")
        return {r["source"]: r["most"] for r in quality.cutoffs(sketches).collect()}

    fences = [most(n)["poems"] for n in (1, 10, 30, 100, 1000)]
    assert fences[0] < 60 and fences[-1] == 103 + 6 * 2
    assert most(1)["web"] == 23 + 6 * 2
    assert len(set(fences)) > 2


def test_filter_keeps_clashing_columns(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(80)), "en", "web", 5, "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, kept string, _lines int")
    assert [tuple(r) for r in quality.quality_filter(docs).collect()] == rows


# -- op 3


def test_draws_against_a_plain_tree(spark):
    topology = [*sharding.even_topology(2, 2, 2), sharding.Leaf("x", "x/k0", 8, 2.5), sharding.Leaf("x", "x/k1", 9, 0.0)]
    keys = spark.range(200).withColumnRenamed("id", "doc_id")
    nodes = sorted({x.region for x in topology} | {x.rack for x in topology} | {f"{x.rack}/s{x.shard}" for x in topology})
    hashed = keys.select("doc_id", *(F.xxhash64("doc_id", F.lit(n)).alias(f"h{i}") for i, n in enumerate(nodes))).collect()
    got = {r["doc_id"]: r["s"] for r in sharding.place(keys, topology, "doc_id", "s").collect()}
    for r in hashed:
        assert got[r["doc_id"]] == brute.tree_place(lambda n, r=r: r[f"h{nodes.index(n)}"], topology)


# -- op 4


def test_expectation_maximisation_finds_reliabilities():
    """Votes of three simulated labelers with known reliabilities."""
    draw = random.Random(7)
    right = {"v1": 0.95, "v2": 0.7, "v3": 0.85}
    counts, truths = {}, {}
    for _ in range(20_000):
        truth = draw.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if draw.random() < right[v] else -1) if draw.random() < 0.8 else 0 for v in pii.VOTES)
        counts[votes] = counts.get(votes, 0) + 1
        truths[votes] = truths.get(votes, 0) + truth
    patterns = [dict(zip(pii.VOTES, votes, strict=True), kind="name", n=n) for votes, n in sorted(counts.items())]
    sure = pii.expectation_maximisation(patterns)
    for x, p in zip(patterns, sure, strict=True):
        votes = tuple(x[v] for v in pii.VOTES)
        if x["n"] > 200:
            assert abs(p - truths[votes] / x["n"]) < 0.08, votes
    rows = [x | {"f_size": int(x["v1"] > 0), "f_edge": 0} for x in patterns]
    weights = pii.fit_classifier(rows, sure)
    good = 0
    for x, p in zip(rows, sure, strict=True):
        odds = weights["", ""] + sum(weights[f, x[f]] for f in pii.FEATURES)
        good += x["n"] * ((odds > 0) == (p > 0.5))
    assert good / sum(counts.values()) > 0.97


def test_votes_decide_on_the_doubtful_spans(spark):
    """Local numbers after a cue are told from like numbers after a counter-cue."""
    rows = [(i, f"please call the office phone {212 + i % 5}-{555 + i % 9}-{1000 + i} today") for i in range(60)]
    rows += [(100 + i, f"see the invoice order serial 0{i % 10}{i % 7}-{100 + i}-{1000 + i} of part") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    yes = sum(any(x["kind"] == "phone_local" for x in found[i]) for i in range(60))
    no = sum(bool(found[100 + i]) for i in range(60))
    assert yes == 60 and no == 0


# -- op 5


def test_line_dedup_keeps_clashing_columns(spark):
    text = "a one\nb two\nc three\nd four"
    rows = [(1, text, 5, 6, "x"), (2, text, 7, 8, "y"), (3, None, 9, 10, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _th long, n_lines int, _lines string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "_th", "_lines", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, text, 5, "x", 4, 0), (2, "", 7, "y", 4, 4), (3, None, 9, "z", 0, 0)]
    left = line_dedup.without_repeats(docs)
    assert left.columns == docs.columns and sorted(r["n_lines"] for r in left.collect()) == [6, 10]


# -- op 6

DEK = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: {cipher},{iv}\n\n{body}\n-----END RSA PRIVATE KEY-----"


@pytest.mark.parametrize(
    ("cipher", "iv", "size", "found"),
    [("AES-128-CBC", "0" * 32, 64, True), ("DES-EDE3-CBC", "A" * 16, 40, True), ("AES-128-CBC", "0" * 16, 64, False), ("AES-256-CBC", "0" * 32, 60, False), ("ROT-13", "0" * 32, 64, False)],
)
def test_old_encrypted_blocks(cipher, iv, size, found):
    import base64

    text = DEK.format(cipher=cipher, iv=iv, body=base64.b64encode(bytes(range(size))).decode())
    assert ("pem" in {k for k, _, _ in find_secrets(text)}) == found


def test_public_keys_are_no_secrets():
    import base64

    field = lambda x: len(x).to_bytes(4, "big") + x
    key = base64.b64encode(field(b"ssh-ed25519") + field(bytes(range(32)))).decode()
    assert not {k for k, _, _ in find_secrets(f"ssh-ed25519 {key} me@host")} & {"der", "pem"}


# -- op 10


def test_tied_turns_are_ordered_by_role_and_text(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, 0, "user", "zebra"), (1, 0, "assistant", "ok"), (1, 0, "system", "s"), (1, 0, "user", "apple pie"), (1, 0, None, "b"), (1, 0, "", "a"), (1, None, "user", "first"), (2, 0, "user", "long " * 20_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: chat.read_turns(np.array(r["ids"]), np.array(r["loss_mask"]), path) for r in chat.format_chats(turns, path).collect()}
    assert got[1][0] == [("user", "first"), ("", "a"), ("", "b"), ("assistant", "ok"), ("system", "s"), ("user", "apple pie"), ("user", "zebra")]
    assert got[1][1] == ["ok"]
    assert got[2][0] == [("user", "long " * 20_000)]


def test_no_conversations(spark):
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string, ids long")
    out = chat.format_chats(turns, public_tokenizers.path("byte_bpe_50k.json"))
    assert out.columns == ["conv_id", "ids", "loss_mask"] and out.count() == 0
