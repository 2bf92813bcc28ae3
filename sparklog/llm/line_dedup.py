"""Op 5: remove lines that repeat in runs of three.

A window is three consecutive lines with a word in them (blank lines are passed over). Windows
are hashed and counted over all documents; the first occurrence of a window, by document id and
place, stays, and the lines that any later occurrence covers go. A line that goes has an equal
line earlier, so the earliest copy of every line stays. Windows are judged on the input.

Defined cases: null text stays null; fewer than three lines with a word: nothing is removed;
blank lines stay; the id may be null (it comes first) and need not be unique: rows with the same
id and text count as one document and get the same result, equal ids with different texts are
different documents in the order of their texts' hashes; an empty table gives an empty table;
further columns are kept as they are, but the result's n_lines and n_removed win over
columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import WORD_CHAR, table


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 3) -> DataFrame:
    """_id, _hash (the text's hash), _starts, the windows to remove, and _full, the number of lines
    with a word, for each document that has windows to remove."""
    full = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(WORD_CHAR))
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_hash"), full.alias("_l"))
    at = lambda i, k: F.get(F.col("_l"), i + k)
    windows = (
        lines.where(F.size("_l") >= run)
        .select(
            "_id",
            "_hash",
            F.size("_l").alias("full"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.size("_l") - run),
                    lambda i: F.struct(
                        i.alias("k"),
                        F.xxhash64(*(at(i, k) for k in range(run))).alias("h"),
                        F.xxhash64(F.lit(run), *(at(i, k) for k in reversed(range(run)))).alias("g"),
                    ),
                )
            ).alias("w"),
        )
        .select("_id", "_hash", "full", "w.k", "w.h", "w.g")
    )
    here = F.struct("_id", "_hash", "k")
    first = windows.groupBy("h", "g").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h", "g"]).where(~here.eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_hash").agg(F.collect_set("k").alias("_starts"), F.max("full").alias("_full"))


def _cleaned(docs: DataFrame, key: str, text: str, run: int) -> DataFrame:
    """_d, the columns of docs as a struct, so that none clashes with a helper; _text, the cleaned
    text; _n, all lines; _cut, how many go; _full, lines with a word before, null if none goes."""
    held = docs.select(F.struct(*docs.columns).alias("_d"), F.xxhash64(text).alias("_th"))
    marks = repeated_lines(docs, key, text, run)
    joined = held.join(marks, held[f"_d.{key}"].eqNullSafe(marks["_id"]) & (held["_th"] == marks["_hash"]), "left")
    own = F.col(f"_d.{text}")
    marked = joined.select("_d", "_starts", "_full", F.split(own, "\n", -1).alias("_lines"))
    places = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get(F.col("_lines"), i).rlike(WORD_CHAR))
    covered = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (run - 1)))))
    marked = marked.withColumn("_places", F.when(F.col("_starts").isNotNull(), places)).withColumn("_gone", covered)
    cut = F.transform("_gone", lambda k: F.get(F.col("_places"), k))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), cut)
    cleaned = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    return marked.select(
        "_d",
        F.when(F.col("_starts").isNull(), own).otherwise(cleaned).alias("_text"),
        F.when(own.isNull(), F.lit(0)).otherwise(F.coalesce(F.size("_lines"), F.lit(0))).cast("long").alias("_n"),
        F.coalesce(F.when(F.col("_starts").isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias("_cut"),
        "_full",
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 3) -> DataFrame:
    """docs with the text cleaned, and n_lines and n_removed (blank lines count among n_lines)."""
    own = [F.col("_text").alias(text) if c == text else F.col(f"_d.{c}").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _cleaned(docs, key, text, run).select(*own, F.col("_n").alias("n_lines"), F.col("_cut").alias("n_removed"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 3) -> DataFrame:
    """docs with the text cleaned, all other columns as they were, without the rows of which no line
    with a word is left. That is told by counts, so that no text is built for a filter."""
    left = _cleaned(docs, key, text, run).where((F.col("_cut") == 0) | (F.col("_cut") < F.col("_full")))
    return left.select(*(F.col("_text").alias(text) if c == text else F.col(f"_d.{c}").alias(c) for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), f AS (
  SELECT doc_id, text, lines,
         list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^\\x20\\x09-\\x0D]')) AS full_at
  FROM l
), w AS (
  SELECT doc_id, k, lines[full_at[k]] || chr(10) || lines[full_at[k + 1]] || chr(10) || lines[full_at[k + 2]] AS s, full_at
  FROM (SELECT *, unnest(range(1, len(full_at) - 1)) AS k FROM f WHERE len(full_at) >= 3)
), later AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS r FROM w
), cut AS (
  SELECT doc_id, list(DISTINCT i) AS gone
  FROM (SELECT doc_id, unnest([full_at[k], full_at[k + 1], full_at[k + 2]]) AS i FROM later WHERE r > 1)
  GROUP BY doc_id
)
SELECT f.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10))
       END AS text
FROM f LEFT JOIN cut ON f.doc_id = cut.doc_id
"""
