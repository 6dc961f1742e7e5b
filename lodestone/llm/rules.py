"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Rules compare shares of a text (symbols, marks, repeated lines, repeated five-word windows)
with a cutoff. Which cutoff, and whether any, is decided for each stratum by labelled
holdouts: of the good texts of the stratum, k of n would be rejected. A cutoff is certified
when the exact binomial tail P(Bin(n, risk) <= k) is at most delta over the number of
(stratum, rule) pairs. Cutoffs are tested from the loosest to the strictest and testing
stops at the first that fails, which needs no further correction. So with probability
1 - delta no rule rejects more than `risk` of the good texts of any stratum, and all rules
together at most RULES times that.

Null texts have no word. A null stratum is one of its own. Strata without enough labelled
texts keep all that the base rules keep. Rows may repeat; each is judged for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.tables import checkpoint, known_labels
from lodestone.plans.sizing import lookup_join

#: Separators of words as a Java and DuckDB character class.
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MARKS = "[!?]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Shares of good texts that one rule may reject, and the chance that this is exceeded anywhere.
RISK, DELTA = 0.025, 0.05
#: Cutoffs of every rule, from the loosest to the strictest.
CUTOFFS = (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)
#: Rule: numerator and denominator among the measured columns.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found at least twice, by hashes of the windows."""
    def of_windows(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_with(ordered, of_ordered))

    def of_ordered(s: Column) -> Column:
        same = lambda e, other: other["x"].eqNullSafe(e["x"])
        twice = F.filter(s, lambda e, i: same(e, F.get(s, i - 1)) | same(e, F.get(s, i + 1)))
        return _with(F.sort_array(F.transform(twice, lambda e: e["i"])), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda at, i: F.least(F.lit(WINDOW), at - F.coalesce(F.get(p, i - 1), F.lit(-WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def windows(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_with(hashes, lambda h: _with(windows(h), of_windows)))


def measure(docs: DataFrame, stratum: Column) -> DataFrame:
    """One row per document: doc_id, stratum and the measured counts of its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = _with(
        F.array_remove(F.split(text, SPACES), ""),
        lambda w: F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeats")
        ),
    )
    of_lines = _with(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    found = docs.select(
        "doc_id", F.coalesce(stratum.cast("string"), F.lit("\u0000")).alias("stratum"), of_words.alias("w"),
        of_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(MARKS)).cast("long").alias("n_marks"),
    )
    return found.select(
        "doc_id", "stratum", F.col("w.n").cast("long").alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"),
        "n_symbols", (F.col("l.n") - F.col("l.distinct")).cast("long").alias("n_dup_lines"),
        F.col("w.repeats").cast("long").alias("n_repeat_words"), "n_marks", F.col("l.n").cast("long").alias("n_lines"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )


def _beyond(rule: str, cutoff: Column) -> Column:
    top, bottom = RULES[rule]
    return F.col(top) > cutoff * F.col(bottom)


def binomial_tail(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), summed in logarithms term by term."""
    odds = F.lit(risk / (1 - risk))
    first = n * F.log1p(F.lit(-risk))
    state = F.struct(first.alias("term"), first.alias("total"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j * odds)
        top = F.greatest(term, s["total"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(-F.abs(term - s["total"])))).alias("total"))

    terms = F.filter(F.sequence(F.lit(0).cast("long"), k), lambda j: j > 0)
    # beyond the mean the tail is above one half, never small enough
    return F.when(k > n * risk, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, state, step, lambda s: s["total"])))


def certify(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, cut_<rule> ...): the strictest certified cutoff of each rule, null for none.

    holdout: measured good texts that pass the base rules.
    """
    counts = [
        F.sum(_beyond(rule, F.lit(c)).cast("long")).alias(f"{rule}_{i}") for rule in RULES for i, c in enumerate(CUTOFFS)
    ]
    wide = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    wide = wide.withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * len(RULES))
    each = wide.select(
        "stratum", "n", "tests",
        F.explode(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"{rule}_{i}").alias("k"))
            for rule in RULES for i, c in enumerate(CUTOFFS)
        ])).alias("t"),
    ).select("stratum", "n", "tests", "t.*")
    passed = binomial_tail(F.col("n"), F.col("k"), risk) <= F.lit(delta) / F.col("tests")
    looser = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    certified = each.withColumn("ok", F.min(passed).over(looser)).filter("ok")
    return certified.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES]
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: Column | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The stratum is the language of the document unless another column is given.
    """
    measured = checkpoint(measure(docs, F.col("lang") if stratum is None else stratum))
    good = known_labels(labels, "quality").filter("label = 1").select("doc_id")
    holdout = measured.filter("not base_failed").join(good, "doc_id", "left_semi")
    limits = checkpoint(certify(holdout))
    judged = lookup_join(measured, limits, "stratum", "doc_id", "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_beyond(rule, F.col(f"cut_{rule}")), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )
