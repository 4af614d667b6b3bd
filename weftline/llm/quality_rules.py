"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Every rule compares a feature of a text with a cutoff. For each stratum (language), rule and cutoff of a fixed grid,
labelled holdout documents give the number of good documents that it would reject; the exact binomial test, corrected
for all tests made, keeps the cutoffs whose false rejection rate is below the rule's share of the allowed risk. Of
these the one that rejects most is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import let, text_of, window_hashes, words
from weftline.session import materialize

#: False rejections allowed per stratum over all rules, and the probability that any statement about them is wrong.
RISK, ERROR = 0.05, 0.05
#: Rows to choose from are those whose fold, doc_id modulo FOLDS, isn't AUDIT; on the others ``audit`` tests the choice.
FOLDS, AUDIT = 4, 0
#: Strata that a broadcast of the cutoffs holds at most; with more they are joined by a shuffle.
MOST_STRATA = 10_000

WHITE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Rules: name, feature in whole numbers, and cutoffs from the least to the most rejecting. A feature at or over the
#: cutoff is rejected.
RULES = (
    ("symbols", "1000 * n_symbols div greatest(word_chars, 1)", (400, 300, 200, 100, 50, 20)),
    ("repeats", "1000 * n_repeat_words div greatest(n_words, 1)", (190, 150, 100, 60, 30, 10)),
    ("dup_lines", "1000 * n_dup_lines div greatest(n_words, 1)", (200, 100, 50, 20, 10, 5)),
    ("long_words", "10 * word_chars div greatest(n_words, 1)", (200, 150, 120, 100, 90, 80)),
    ("few_words", "1000 div greatest(n_words, 1)", (83, 66, 50, 33, 25, 20)),
)


def repeated_words(found: Column, width: int = 5) -> Column:
    """How many of a text's words are in windows of ``width`` words that it has twice or more."""

    def covered(places: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(places) - 2)
        inner = F.aggregate(steps, F.lit(width), lambda n, k: n + F.least(F.lit(width), F.get(places, k + 1) - F.get(places, k)))
        return F.when(F.size(places) > 1, inner).otherwise(0)

    def places(pairs: Column) -> Column:
        same = lambda k, d: F.get(pairs, k)["h"].eqNullSafe(F.get(pairs, k + d)["h"])
        hit = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, -1) | same(k, 1))
        return F.array_sort(F.transform(hit, lambda k: F.get(pairs, k)["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, places), covered)).otherwise(0)

    return let(window_hashes(found, width), count).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the base features of each row of ``docs(doc_id, text, lang)``; no shuffle.

    A null text is an empty one, a null language the stratum "und".
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("stratum"), text_of().cast("string").alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    own = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    rows = rows.select(
        "doc_id",
        "stratum",
        own.alias("own"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select("doc_id", "stratum", "own.n_words", "word_chars", "n_symbols", "n_dup_lines", "own.n_repeat_words")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def at_most(k: Column, n: Column, p: float) -> Column:
    """P[X <= k] of a binomial X(n, p), for k up to n p: terms by their ratios, in logarithms."""
    from math import log

    first = n * log(1 - p)
    step = lambda acc, i: acc["log"] + F.log((n - i + 1) / i) + log(p / (1 - p))
    add = lambda acc, i: F.struct(step(acc, i).alias("log"), (acc["sum"] + F.exp(step(acc, i))).alias("sum"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, F.struct(first.alias("log"), F.exp(first).alias("sum")), add, lambda acc: acc["sum"])


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of good documents that pass the base. A document with several labels counts by its best."""
    doc_id = F.col("doc_id").cast("long")
    good = labels.select(doc_id.alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    good = good.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality > 0").select("doc_id")
    return rows.where(~F.col("base_failed")).join(good, "doc_id")


def failed_rules() -> Column:
    return F.array_compact(F.array(*(F.when(F.expr(value) >= F.col(f"cut_{name}"), F.lit(name)) for name, value, _ in RULES)))


def audit(rows: DataFrame, labels: DataFrame, cutoffs: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, n, n_rejected, p_value and confirmed: the cutoffs on the good documents that had no part in choosing them.

    ``p_value`` is the exact probability of so few rejections if the rate were ``risk`` over all rules together; a
    stratum is confirmed if it is ``error`` or less. Too few audit rows confirm nothing, which is no contradiction.
    """
    unseen = labelled(rows, labels).where(F.pmod(F.col("doc_id"), F.lit(FOLDS)) == AUDIT).join(F.broadcast(cutoffs), "stratum")
    counts = unseen.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.size(failed_rules()) > 0).alias("n_rejected"))
    tail = F.when(F.col("n_rejected") <= F.col("n") * risk, at_most(F.col("n_rejected"), F.col("n"), risk)).otherwise(1.0)
    return counts.withColumn("p_value", tail).withColumn("confirmed", F.col("p_value") <= error)


def choose_cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum and a cutoff for each rule (null: none is safe), for strata that have any.

    ``rows`` is what ``features`` gives. Base failures are left out, as no cutoff decides on them.
    """
    held = labelled(rows, labels).where(F.pmod(F.col("doc_id"), F.lit(FOLDS)) != AUDIT)
    rejects = [F.sum((F.expr(value) >= cut).cast("long")).alias(f"{name}_{cut}") for name, value, cuts in RULES for cut in cuts]
    counts = materialize(held.groupBy("stratum").agg(F.count("*").alias("n"), *rejects), "rule-counts")
    tests = counts.count() * sum(len(cuts) for _, _, cuts in RULES)
    share = risk / len(RULES)
    chosen = []
    for name, _, cuts in RULES:
        safe = [F.when((F.col(k := f"{name}_{cut}") <= F.col("n") * share) & (at_most(F.col(k), F.col("n"), share) <= error / max(1, tests)), cut) for cut in cuts]
        chosen.append(F.least(*safe).alias(f"cut_{name}"))  # the least cutoff rejects most
    return counts.select("stratum", *chosen).where(F.coalesce(*(F.col(f"cut_{name}") for name, _, _ in RULES)).isNotNull())


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The base features, base_failed, kept and failed_rules of each row of ``docs(doc_id, text, lang)``.

    A text that fails the base isn't kept; one of a stratum without safe cutoffs is judged by the base alone, as is
    every text where no labels are given. Repeated rows give repeated results; an empty table gives none.
    """
    rows = materialize(features(docs), "quality-features")
    cutoffs = materialize(choose_cutoffs(rows, labels, risk, error), "quality-cutoffs")
    side = F.broadcast(cutoffs) if cutoffs.count() <= MOST_STRATA else cutoffs
    out = rows.join(side, "stratum", "left").withColumn("failed_rules", failed_rules())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "stratum", "failed_rules")
