"""Op 4: find personal data, by rules that never miss and a classifier for the doubtful rest.

Base spans (email, ip, card, phone) are found by their patterns and always reported. Looser
patterns bring further candidates: spelled-out addresses, telephone numbers without a country
code, social-security-like numbers and titled names. Three labelers vote on every candidate,
base or not: the strictness of its form, gazetteers, and the words around it; each says yes, no or
nothing. Expectation maximisation (Dawid and Skene) estimates from the votes alone how reliable
each labeler is and how likely each pattern of votes is personal data. A logistic span
classifier is then trained on those probabilities with features of the span, and decides on the
candidates that are not base spans. Overlaps go to base spans, then to the earlier candidate.

Both fits need only counts of patterns, which Spark aggregates over all documents: their number
is bounded by the products of votes and features (5,832), not by the corpus.

Positions come from running sums over a document's matches and the gaps between them, so no
Python sees a text. Patterns are written so that each runs in time linear in the text.

Defined cases: null text is empty; every row is scanned by itself, so ids may be null or repeat;
no candidate at all leaves the classifier unfitted and unused; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.llm.common import materialize, table

BASE = ["email", "ip", "card", "phone"]
MORE = ["email_words", "phone_local", "ssn", "name"]
KINDS = BASE + MORE
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORDS_AT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,12}"
_PHONE = r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NAME = r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?"
LOOSE = f"{_WORDS_AT}|{_PHONE}|{_SSN}|{_NAME}"
#: Fixed word lists of the labelers.
TOP_DOMAINS = "com org net edu gov int io de fr es uk it nl eu ch at be us ca info biz"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92"
FIRST_NAMES = "Anna Anne Carlos Claire David Elena Emma Hans James Jean John José Juan Julia Karl Laura Luis Maria Marie Mary Michael Paul Peter Pierre Robert Sarah Thomas"
CUES = "mail e-mail email contact phone tel telefon call mobile fax ip host server card visa ssn write kontakt correo courriel appelez llame"
COUNTER_CUES = "version order invoice isbn build release part serial ticket page chapter section figure"


def _candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """rid, id and, for each match, kind, m, start, end, before, after; a row without kind for each document."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    digits = F.col("t").rlike("[0-9]")
    may = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+"), "ip": digits, "card": digits, "loose": F.lit(True)}
    patterns = PATTERNS | {"loose": LOOSE}
    cut = base.select(
        "rid",
        "id",
        *(F.when(may[k], F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias(f"m_{k}") for k, p in patterns.items()),
        *(F.when(may[k], F.split("t", p, -1)).alias(f"s_{k}") for k, p in patterns.items()),
    )

    def rows(k: str) -> Column:
        gap = lambda i: F.get(F.col(f"s_{k}"), i)
        one = lambda m, i: F.struct(
            F.lit(k).alias("kind"),
            i.alias("i"),
            m.alias("m"),
            F.length(gap(i)).cast("long").alias("gap"),
            F.right(gap(i), F.lit(40)).alias("before"),
            F.left(gap(i + 1), F.lit(1)).alias("after"),
        )
        return F.coalesce(F.transform(f"m_{k}", one), F.array().cast("array<struct<kind:string,i:int,m:string,gap:bigint,before:string,after:string>>"))

    own = F.array(F.lit(None).cast("struct<kind:string,i:int,m:string,gap:bigint,before:string,after:string>"))
    flat = cut.select("rid", "id", F.explode_outer(F.concat(own, *map(rows, patterns))).alias("x")).select("rid", "id", "x.*")
    line = Window.partitionBy("rid", "kind").orderBy("i")
    end = F.when(F.col("kind").isNotNull(), F.sum(F.col("gap") + F.length("m")).over(line))
    return flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")).drop("gap", "i")


def _passes() -> Column:
    """Whether a base match meets its kind's conditions; true for the loose ones."""
    m = F.col("m")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    number = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(number)
    luhn = F.coalesce(F.call_function("luhn_check", F.when(n.between(12, 19), number)), F.lit(False))
    return (
        F.when(F.col("kind") == "ip", m.rlike(rf"^(?:{part}\.){{3}}{part}$"))
        .when(F.col("kind") == "card", luhn)
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(F.lit(True))
    )


def _in(value: Column, words: str) -> Column:
    return value.isin(*words.split())


def _votes(found: DataFrame) -> DataFrame:
    """Add the labelers' votes v1, v2, v3 (1 yes, -1 no, 0 nothing) and the features."""
    m, k = F.col("m"), F.col("kind")
    number = F.regexp_replace(m, "[^0-9]", "")
    first = F.regexp_extract(m, r"^([0-9]+)", 1)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    form = (
        F.when(k.isin("email", "email_words"), vote(m.rlike(r"[A-Za-z]{2,12}$"), F.lit(True)))
        .when(k == "ip", vote(first.rlike("^[1-9][0-9]{0,2}$") & ~first.isin("0", "127"), F.lit(True)))
        .when(k == "card", vote(number.rlike("^[3-6]"), F.lit(False)))
        .when(k == "phone", vote(F.length(number).between(10, 13), F.lit(False)))
        .when(k == "phone_local", vote(number.rlike("^[0-9]{3}[2-9]"), number.rlike("^[01]{3}")))
        .when(k == "ssn", vote(~number.rlike("^(000|666|9)"), F.lit(True)))
        .otherwise(vote(m.rlike(r" \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$"), F.lit(False)))
    )
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)
    listed = (
        F.when(k.isin("email", "email_words"), vote(_in(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)), TOP_DOMAINS), F.lit(False)))
        .when(k == "ip", vote(F.lit(False), m.rlike(r"^(10|127|192\.168|192\.0\.2|198\.51\.100|203\.0\.113)\.")))
        .when(k == "card", vote(number.rlike("^(4|5[1-5]|3[47]|6011)"), F.lit(False)))
        .when(k == "phone", vote(_in(code, COUNTRY_CODES) | _in(F.left(code, F.lit(2)), COUNTRY_CODES) | _in(F.left(code, F.lit(1)), COUNTRY_CODES), F.lit(False)))
        .when(k == "name", vote(_in(F.regexp_extract(m, r" (\p{Lu}\p{Ll}+)", 1), FIRST_NAMES), F.lit(False)))
        .otherwise(F.lit(0))
    )
    near = F.filter(F.split(F.lower("before"), r"[^\p{L}-]+"), lambda w: w != "")
    has = lambda words: F.arrays_overlap(near, F.array(*map(F.lit, words.split())))
    context = vote(has(CUES), has(COUNTER_CUES))
    return found.withColumns(
        {
            "v1": form,
            "v2": listed,
            "v3": context,
            "f_size": F.when(F.length("m") < 12, 0).when(F.length("m") < 20, 1).otherwise(2),
            "f_edge": (F.col("before").rlike(r"[\p{L}\p{N}]$") | F.col("after").rlike(r"^[\p{L}\p{N}]")).cast("int"),
        }
    )


VOTES = ("v1", "v2", "v3")
FEATURES = ("kind", *VOTES, "f_size", "f_edge")


def expectation_maximisation(patterns: list[dict], rounds: int = 50) -> list[float]:
    """For each pattern (kind, votes, n) the probability that its spans are personal data.

    A kind has a prior, a labeler a distribution of votes for each truth, the same for all
    kinds. It starts from the mean of the votes that were cast.
    """
    sure = []
    for x in patterns:
        cast = [x[v] for v in VOTES if x[v]]
        sure.append(0.5 + 0.4 * sum(cast) / len(cast) if cast else 0.5)
    kinds = sorted({x["kind"] for x in patterns})
    for _ in range(rounds):
        prior = {}
        for k in kinds:
            own = [(x["n"], p) for x, p in zip(patterns, sure, strict=True) if x["kind"] == k]
            prior[k] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)
        says: dict[tuple[str, int, bool], float] = {}
        for v in VOTES:
            for truth in (True, False):
                part = [(x[v], x["n"] * (p if truth else 1 - p)) for x, p in zip(patterns, sure, strict=True)]
                total = sum(n for _, n in part) + 3
                for value in (-1, 0, 1):
                    # a labeler is taken to be better than chance at the start
                    agree = 1 + 0.5 * (value if truth else -value)
                    says[v, value, truth] = (sum(n for w, n in part if w == value) + agree) / total
        for i, x in enumerate(patterns):
            yes, no = prior[x["kind"]], 1 - prior[x["kind"]]
            for v in VOTES:
                yes, no = yes * says[v, x[v], True], no * says[v, x[v], False]
            sure[i] = yes / (yes + no)
    return sure


def fit_classifier(patterns: list[dict], sure: list[float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple[str, object], float]:
    """Logistic regression on one-hot features, by gradient steps over the patterns' counts."""
    weights = {(f, x[f]): 0.0 for x in patterns for f in FEATURES} | {("", ""): 0.0}
    total = sum(x["n"] for x in patterns)
    for _ in range(rounds):
        step = {w: -decay * value for w, value in weights.items()}
        for x, p in zip(patterns, sure, strict=True):
            on = [(f, x[f]) for f in FEATURES] + [("", "")]
            error = p - 1 / (1 + exp(-sum(weights[w] for w in on)))
            for w in on:
                step[w] += error * x["n"] / total
        for w in weights:
            weights[w] += rate * step[w]
    return weights


def score(weights: dict[tuple[str, object], float]) -> Column:
    """The classifier's log odds; unseen values count nothing."""
    out = F.lit(weights.get(("", ""), 0.0))
    for f in FEATURES:
        term = F.lit(0.0)
        for (g, value), w in sorted(weights.items(), key=str):
            if g == f:
                term = F.when(F.col(f) == value, F.lit(w)).otherwise(term)
        out = out + term
    return out


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, the (start, rank of the kind, kind, end) of each span in order, for every row."""
    found = _candidates(docs, key, text)
    loose = F.when(F.col("m").rlike(f"^(?:{_SSN})$"), "ssn").when(F.col("m").rlike(f"^(?:{_PHONE})$"), "phone_local")
    loose = loose.when(F.col("m").rlike(r"(?:\(at\)|\[at\])"), "email_words").otherwise("name")
    found = found.where(F.col("kind").isNull() | _passes())
    found = found.withColumn("kind", F.when(F.col("kind") == "loose", loose).otherwise(F.col("kind")))
    stored = materialize(_votes(found).drop("m", "before", "after"), "candidates")
    counted = stored.where("kind is not null").groupBy(*FEATURES).agg(F.count("*").alias("n"))
    patterns = [r.asDict() for r in counted.orderBy(*FEATURES).collect()]  # bounded, see above
    sure = expectation_maximisation(patterns)
    odds = score(fit_classifier(patterns, sure)) if patterns else F.lit(-1.0)
    is_base = F.col("kind").isin(*BASE)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    chosen = stored.withColumn("span", F.when(is_base | (odds > 0), F.struct("start", rank.alias("rank"), "kind", "end")))
    grouped = chosen.groupBy("rid").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("span")).alias("all"))
    base = F.filter("all", lambda x: x["rank"] <= len(BASE))
    more = F.filter("all", lambda x: x["rank"] > len(BASE))
    apart = lambda x, others: ~F.exists(others, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    free = F.filter("more", lambda x: apart(x, F.col("base")))
    out = grouped.select("id", base.alias("base"), more.alias("more"))
    out = out.select("id", F.when(F.size("more") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", free))).alias("spans"))
    return out.withColumnRenamed("id", key)


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
