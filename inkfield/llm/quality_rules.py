"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Measures of every whole text are taken inside the row. A rule is a measure with
a cutoff; a document is rejected by a rule when its measure is over the cutoff.
Cutoffs come from a fixed grid for each stratum: on labelled good documents of
the stratum, a cutoff is admissible when its false rejections are so few that a
true rate of over ``risk`` would show so few with a probability of at most
``doubt`` divided by the number of tests made in all strata (exact binomial
tail, Bonferroni). Of a rule's admissible cutoffs one with the fewest false
rejections is taken, and of those the lowest. ``risk`` is equally between the rules, so the rules of a stratum together reject more than ``risk`` of its good documents with a probability of at most
``doubt``. A stratum with too few labels for a proof has no cutoff and rejects
nothing by it.

A null text has no words; a text without words fails the base. Ties with a
cutoff are kept. A null stratum is a stratum of its own. Null labels and null
ids are left out of the labels; repeated labels count once, the smallest one.
Repeated rows are judged alike. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from inkfield.llm.common import NO_ID, Bench, given_id

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Share of a stratum's good documents that all rules together may reject, and the probability of being wrong about it.
RISK, DOUBT = 0.04, 0.05
#: Cutoffs tried for every rule, in hundredths.
GRID = (2, 5, 10, 15, 20, 30, 40, 50, 60, 70, 80, 90)
MEASURES = ("symbol_share", "line_share", "repeat_share", "mark_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def percent(part: Column, whole: Column) -> Column:
    """Hundredths as an exact whole number, rounded up, so that a cutoff splits all engines' rows alike."""
    return F.when(whole > 0, F.ceil(part * 100 / whole)).otherwise(0).cast("long")


def measured(docs: DataFrame, doc_id: str, text: str, stratum: str) -> DataFrame:
    """doc_id, stratum and the counts of every whole text.

    Each step is a projection of its own, so that what a lambda reads again and
    again is a column, computed once for a row.
    """
    own = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    split = own.select(
        "doc_id", "stratum",
        F.filter(F.split("text", BLANKS, -1), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", "!", ""))).cast("long").alias("n_marks"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = split.select(
        "doc_id", "stratum", "word_chars", "n_symbols", "n_marks", "words",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    word = lambda i: F.get("words", i)
    windows = counted.withColumn(
        "windows",
        F.when(
            F.col("n_words") >= 3,
            F.sort_array(F.transform(
                F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
                lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("i")),
            )),
        ),
    ).drop("words")
    # The whole sorted array is looked into by place: a field of it, taken out first, would be taken out again for every element.
    hash_at = lambda k: F.get("windows", k)["h"]
    found = windows.withColumn(
        "places",
        F.sort_array(F.filter(
            F.transform("windows", lambda w, k: F.when((hash_at(k - 1) == w["h"]) | (hash_at(k + 1) == w["h"]), w["i"])),
            lambda i: i.isNotNull(),
        )),
    ).drop("windows")
    gaps = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return found.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_marks",
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def with_shares(counts: DataFrame) -> DataFrame:
    return counts.select(
        "*",
        percent(F.col("n_symbols"), F.col("word_chars")).alias("symbol_share"),
        percent(F.col("n_dup_lines"), F.col("n_words")).alias("line_share"),
        percent(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        percent(F.col("n_marks"), F.col("word_chars")).alias("mark_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def tail(errors: Column, trials: Column, rate: float) -> Column:
    """log of P(X <= errors) for ``trials`` draws at ``rate``, summed term by term in logarithms."""
    odds = F.lit(math.log(rate / (1 - rate)))
    none = trials * math.log(1 - rate)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((trials - i + 1) / i) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    draws = F.sequence(F.lit(1), F.greatest(errors, F.lit(1)).cast("int"))
    sums = F.aggregate(draws, F.struct(none.alias("term"), none.alias("total")), add, lambda acc: acc["total"])
    return F.when(errors == 0, none).otherwise(sums)


def cutoffs(shares: DataFrame, labels: DataFrame, bench: Bench, risk: float, doubt: float, doc_id: str, label: str) -> DataFrame:
    """A row per stratum that has any cutoff: stratum and, in hundredths, each rule's cutoff or null."""
    good = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
        .where("label = 1").select("doc_id")
    )
    sums = bench.keep(
        shares.where("NOT base_failed").join(good, "doc_id").groupBy("stratum").agg(
            F.count("*").alias("n"),
            *(F.sum((F.col(m) > c).cast("long")).alias(f"{m}_{c}") for m in MEASURES for c in GRID),
        ),
        "sums",
    )
    each, level = risk / len(MEASURES), math.log(doubt / (max(1, sums.count()) * len(MEASURES) * len(GRID)))
    tries = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{m}_{c}").alias("errors")) for m in MEASURES for c in GRID))
    tests = sums.select("stratum", "n", F.explode(tries).alias("t")).select("stratum", "n", "t.*")
    admissible = tests.where((F.col("errors") <= F.col("n") * each) & (tail(F.col("errors"), F.col("n"), each) <= level))
    best = admissible.groupBy("stratum", "measure").agg(F.min(F.struct("errors", "cutoff")).alias("best"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("measure") == m, F.col("best.cutoff"))).alias(f"{m}_cutoff") for m in MEASURES))


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality",
    risk: float = RISK, doubt: float = DOUBT,
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    bench = Bench(docs.sparkSession, "quality-rules")
    shares = with_shares(bench.keep(measured(docs, doc_id, text, stratum), "counts"))
    found = bench.keep(cutoffs(shares, labels, bench, risk, doubt, doc_id, label), "cutoffs").withColumnRenamed("stratum", "of")
    # The few rows of the right side are sent to every task by Spark while they are under its threshold; beyond it a hot stratum is split.
    both = shares.join(found, F.col("stratum").eqNullSafe(F.col("of")), "left")
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(m) > F.col(f"{m}_cutoff"), F.lit(False))
    return both.select(given_id(), *COUNTS, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))
