"""Op 2: quality rules whose cutoffs are learnt from the corpus.

Every document gets the base counts (see ``measure``). Five rates of whole numbers, such as
symbols per thousand word characters, are summarised by language and source in a quantile
sketch: counts of logarithmic buckets, exact below 128 and within 1/64 above. Such sketches merge
by adding counts, so partial ones are summed before the shuffle. Every group's sketch is blended
with its language's as if that brought PRIOR_DOCS documents more, and the language's with the
corpus's likewise, so that a small group leans on its parents and a large one on itself, without
a switch. A rate's cutoff lies REACH interquartile ranges beyond the quartiles; where these
coincide, as for rates that are zero in most documents, they tell no width, and the rate's fixed
margin stands in for it. A document is kept if it passes the base rule and no rate lies beyond
its cutoff.

Defined cases: null text has no words and fails the base rule; null language or source form
groups of their own; every row is judged by itself, so repeated rows and ids don't matter; an
empty table gives an empty table; extra columns stay, and the result's names win over clashing
ones (quality_filter() returns the columns of docs as they were).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.llm.common import WORD_CHAR, materialize, table, words_of

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: rate: (margin where the quartiles coincide, whether low values are bad as well)
RATES = {
    "symbol_rate": (50, False),
    "dup_line_rate": (400, False),
    "repeat_rate": (400, False),
    "char_rate": (300, True),
    "line_rate": (500, False),
}
#: Documents that a parent's sketch counts for, and the fence in interquartile ranges.
PRIOR_DOCS, REACH = 100, 6
#: One document in the blended counts, which are whole numbers.
UNIT = 1 << 20


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the rates to docs.

    n_words; word_chars, code points in words; n_symbols; n_dup_lines, lines with a word that
    equal an earlier line of the text; n_repeat_words, words in three-word windows found twice
    or more in the text. Write the result (materialize) before filtering on these columns: Spark
    would push the filter below and compute them anew for every element of the arrays.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD_CHAR))
    out = docs.withColumn("_quality_w", words_of(F.col(text)))
    word = lambda i, k: F.get(F.col("_quality_w"), i + k)
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("_quality_w") - 3), lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2))
    )
    out = out.withColumn("_quality_h", F.when(F.size("_quality_w") >= 3, hashes).otherwise(F.array().cast("array<long>")))
    pairs = F.sort_array(F.transform("_quality_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("_quality_h")) < F.size("_quality_h")
    out = out.withColumn("_quality_p", F.when(some, pairs))
    same = lambda x, k: F.coalesce(F.get(F.col("_quality_p"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter("_quality_p", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn("_quality_i", F.transform(twice, lambda x: x["i"])).withColumn("_quality_lines", lines)
    covered = F.size(F.array_distinct(F.concat("_quality_i", F.transform("_quality_i", lambda i: i + 1), F.transform("_quality_i", lambda i: i + 2))))
    out = out.withColumns(
        {
            "n_words": F.size("_quality_w").cast("long"),
            "word_chars": F.length(F.array_join("_quality_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_quality_lines") - F.size(F.array_distinct("_quality_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_quality_i").isNull(), F.lit(0)).otherwise(covered).cast("long"),
            "_quality_n_lines": F.size("_quality_lines").cast("long"),
        }
    )
    per = lambda a, b, k: F.floor(F.col(a) * F.lit(k) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return out.withColumns(
        {
            "symbol_rate": per("n_symbols", "word_chars", 1000),
            "dup_line_rate": per("n_dup_lines", "_quality_n_lines", 1000),
            "repeat_rate": per("n_repeat_words", "n_words", 1000),
            "char_rate": per("word_chars", "n_words", 100),
            "line_rate": per("_quality_n_lines", "n_words", 1000),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    ).drop("_quality_w", "_quality_h", "_quality_p", "_quality_i", "_quality_lines", "_quality_n_lines")


def bucket(x: Column) -> Column:
    """Below 128 the number itself; above, the seven leading bits and the number of the others."""
    e = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return (e * 128 + F.floor(x / F.pow(F.lit(2.0), e))).cast("long")


def bucket_floor(b: Column) -> Column:
    """The least number of a bucket."""
    return ((b % 128) * F.pow(F.lit(2.0), F.floor(b / 128))).cast("long")


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: the mergeable sketches of all documents that pass the base rule."""
    rates = F.array(*(F.struct(F.lit(r).alias("rate"), bucket(F.col(r)).alias("bucket")) for r in RATES))
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(rates).alias("x"))
        .groupBy("lang", "source", "x.rate", "x.bucket")
        .agg(F.count("*").alias("n"))
    )


def _blend(own: DataFrame, parent: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """by, rate, bucket and w: own's counts n in UNITs, and PRIOR_DOCS documents dealt like parent's w.

    ``shared`` are the keys that parent has; a parent's buckets include its children's.
    """
    total = Window.partitionBy(*shared, "rate")
    prior = parent.withColumn("_prior", F.floor(F.lit(float(PRIOR_DOCS * UNIT)) * (F.col("w") / F.sum("w").over(total))).cast("long"))
    prior = prior.select(*(F.col(c).alias(f"_p_{c}") for c in (*shared, "rate", "bucket")), "_prior")
    groups = own.select(*by, "rate").distinct()
    on = F.lit(True)
    for c in (*shared, "rate"):
        on = on & groups[c].eqNullSafe(prior[f"_p_{c}"])
    spread = groups.join(prior, on).select(*by, "rate", F.col("_p_bucket").alias("bucket"), F.col("_prior").alias("w"))
    counted = own.select(*by, "rate", "bucket", (F.col("n") * UNIT).alias("w"))
    return spread.unionByName(counted).groupBy(*by, "rate", "bucket").agg(F.sum("w").alias("w"))


def cutoffs(sketches: DataFrame) -> DataFrame:
    """lang, source, rate, least, most: a row for each rate of each group that has documents."""
    own = sketches.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    langs = own.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n"))
    corpus = langs.groupBy("rate", "bucket").agg((F.sum("n") * UNIT).alias("w"))
    blended = _blend(own, _blend(langs, corpus, ["lang"], []), ["lang", "source"], ["lang"])
    group = ["lang", "source", "rate"]
    below = F.sum("w").over(Window.partitionBy(*group).orderBy("bucket"))
    ranked = blended.withColumns({"below": below, "total": F.sum("w").over(Window.partitionBy(*group))})
    at = lambda q: F.min(F.when(F.col("below") * 4 >= F.col("total") * q, bucket_floor(F.col("bucket"))))
    known = ranked.groupBy(*group).agg(at(1).alias("q1"), at(3).alias("q3"))
    margin = F.lit(0)
    low = F.lit(False)
    for rate, (fixed, both) in RATES.items():
        margin = F.when(F.col("rate") == rate, F.lit(fixed)).otherwise(margin)
        low = F.when(F.col("rate") == rate, F.lit(both)).otherwise(low)
    reach = F.when(F.col("q1") < F.col("q3"), REACH * (F.col("q3") - F.col("q1"))).otherwise(margin)
    return known.select(*group, F.when(low, F.col("q1") - reach).alias("least"), (F.col("q3") + reach).alias("most"))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add kept: the base rule holds and every rate is within its group's cutoffs.

    ``limits`` has five short rows for each language and source; Spark broadcasts it if it is
    small and shuffles otherwise.
    """
    wide = limits.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("rate") == r, F.col("most"))).alias(f"_most_{r}") for r in RATES),
        *(F.max(F.when(F.col("rate") == r, F.col("least"))).alias(f"_least_{r}") for r in RATES),
    )
    wide = materialize(wide.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in wide.columns if c[0] == "_"]), "cutoffs")
    on = measured["lang"].eqNullSafe(wide["_lang"]) & measured["source"].eqNullSafe(wide["_source"])
    good = ~F.col("base_failed")
    for r in RATES:
        good = good & F.coalesce(F.col(r) <= F.col(f"_most_{r}"), F.lit(True)) & F.coalesce(F.col(r) >= F.col(f"_least_{r}"), F.lit(True))
    out = measured.join(wide, on, "left").withColumn("kept", good)
    return out.drop(*wide.columns)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts, the rates, base_failed and kept.

    The measured rows are written once to the shared folder, with the columns that docs has.
    """
    measured = materialize(measure(docs, text), "quality")
    return judge(measured, cutoffs(sketch(measured)))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their own columns, whatever their names."""
    used = {text, "lang", "source"}
    held = docs.select(*(F.col(c) for c in docs.columns if c in used), F.struct(*docs.columns).alias("_d"))
    measured = materialize(measure(held, text).drop(text), "quality")  # the text is in _d
    kept = judge(measured, cutoffs(sketch(measured))).where("kept")
    return kept.select(*(F.col(f"_d.{c}").alias(c) for c in docs.columns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = materialize(measure(docs).drop("text"), "quality")
    out = judge(measured, cutoffs(sketch(measured)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
