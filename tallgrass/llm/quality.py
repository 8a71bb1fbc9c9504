"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every document gets base counts (words, symbols, repeated lines, words in repeated 8-word windows) in one narrow pass;
windows are compared by 64-bit hashes of their words' hashes. Four rules reject documents whose rate lies beyond a
cutoff. Cutoffs are chosen per stratum on labelled documents that pass the base rules (the promise is about those). One
half of the good ones (by hash of doc_id) proposes a sequence of rule sets, from the loosest to the strictest: every
rule's cutoff at MARGINS times the greatest rate, then at LEVELS of the rates' quantiles. The other half tests each rule
set as a whole, once: with n good documents and x of them rejected by any of the rules, it is valid if x or fewer would
have a probability of at most delta / (number of strata) were the true false rejection alpha (exact binomial bound at
every size). Rule sets are tested in that fixed order and testing stops at the first that is not valid, which needs no
correction over the sequence; strata are corrected by Bonferroni. The last valid set is the stratum's; a stratum
without one keeps everything. So with probability 1 - delta, no stratum loses more than alpha of the good documents
that pass the base rules. A rule that tells nothing in a stratum costs its sequence power, but never the promise.

Only grouped counts leave the labelled pass: (strata x rules x levels) rows. The documents' text is read once; the
counts, a few numbers per document, are written to the shared folder and read for calibration and verdicts.

Defined cases: a null text has no words (and fails the base rule); labels with null doc_id or quality are ignored and
of several labels of a document the best counts; a null stratum is a stratum; repeated rows each get a row, but count
once for a cutoff, as do equal texts of several documents; an empty table gives an empty result; other columns are dropped but for doc_id; rates over zero words are 0.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Proposed cutoffs, loosest first: multiples of the good documents' greatest rate, then quantiles of their rates.
MARGINS, LEVELS = (4.0, 2.0, 1.5, 1.2, 1.0), (0.999, 0.998, 0.996, 0.994, 0.992, 0.99)
ALPHA, DELTA = 0.02, 0.05
#: Strata up to this number are broadcast with their cutoffs.
FEW_STRATA = 10_000


def base_counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every document. See the module for defined cases."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.col(stratum).alias("stratum"), text.alias("t"))
    d = d.withColumns(
        {
            "words": F.filter(F.split("t", SPACE), lambda w: w != ""),
            "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long"),
        }
    )
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    d = d.select(
        "doc_id",
        "stratum",
        F.xxhash64("t").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        hashes.alias("h"),
    )
    d = d.withColumn("w", windows(F.col("h")))
    repeated = F.size(F.array_distinct("w")) < F.size("w")
    placed = F.when(repeated, F.array_sort(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.drop("h").withColumn("s", placed).drop("w")
    m = F.size("s")
    gone = F.lit(None).cast("struct<h:bigint,i:int>")
    before = F.concat(F.array(gone), F.slice("s", F.lit(1), m - 1))
    after = F.concat(F.slice("s", F.lit(2), m - 1), F.array(gone))
    like_before = F.zip_with("s", before, lambda a, b: a.h.eqNullSafe(b.h))
    like_after = F.zip_with("s", after, lambda a, b: a.h.eqNullSafe(b.h))
    either = F.zip_with(like_before, like_after, lambda a, b: a | b)
    starts = F.zip_with("s", either, lambda a, b: F.when(b, a.i))
    starts = F.array_sort(F.filter(starts, lambda i: i.isNotNull()))
    # words from the end of what is covered so far, or from the window's start if that comes later
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, i: F.struct((a.n + i + WINDOW - F.greatest(i, a.to)).alias("n"), (i + WINDOW).alias("to")),
    ).n
    return d.withColumn("n_repeat_words", F.coalesce(F.when(F.col("s").isNotNull(), covered), F.lit(0)).cast("long")).drop("s")


def windows(h: Column) -> Column:
    """Hashes of all windows of WINDOW word hashes."""
    shifted = lambda k: F.slice(h, F.lit(k + 1), F.size(h) - (WINDOW - 1))
    zipped = F.zip_with(shifted(0), shifted(1), lambda a, b: F.xxhash64(a, b))
    two = F.zip_with(shifted(2), shifted(3), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(shifted(4), shifted(5), lambda a, b: F.xxhash64(a, b))
    four = F.zip_with(shifted(6), shifted(7), lambda a, b: F.xxhash64(a, b))
    left = F.zip_with(zipped, two, lambda a, b: F.xxhash64(a, b))
    right = F.zip_with(three, four, lambda a, b: F.xxhash64(a, b))
    full = F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(h) >= WINDOW, full).otherwise(F.array().cast("array<bigint>"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Each rule's rate; a document beyond the cutoff is rejected."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "long_words": share("word_chars", "n_words"),
    }


def stirling_rest(n: Column) -> Column:
    """ln n! minus Stirling's formula for it (n > 0): a series, or the difference itself for small n."""
    exact = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(16)).cast("long")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    small = exact - (n + 0.5) * F.log(n) + n - F.lit(0.9189385332046727)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * n * n)) / (n * n)) / (n * n)) / n
    return F.when(n <= 16, small).otherwise(series)


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), exact at every size; 0 where k is not below the mean, where nothing is proved.

    The term at k by its deviance from the mean, times the sum of the falling terms below it relative to it; terms
    beyond 12 standard deviations below k are less than 1e-30 of it.
    """
    k, n = k.cast("double"), n.cast("double")
    q = 1 - p
    deviance = lambda x, m: x * F.log(x / m) + m - x
    rest = stirling_rest(n) - stirling_rest(k) - stirling_rest(n - k)
    top = rest - deviance(k, n * p) - deviance(n - k, n * q) - 0.5 * F.log(F.lit(6.283185307179586) * k * (n - k) / n)
    count = F.least(k, F.ceil(12 * F.sqrt(n * p * q)) + 64).cast("long")

    def step(a: Column, i: Column) -> Column:
        term = a.term * (k - i + 1) * q / ((n - k + i) * p)
        return F.struct(term.alias("term"), (a.total + term).alias("total"))

    below = F.aggregate(F.sequence(F.lit(1).cast("long"), count), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step).total
    none = n * F.log(F.lit(q))
    return F.when((n <= 0) | (k >= n * p), F.lit(0.0)).when(k <= 0, none).otherwise(top + F.log(below))


def cutoffs(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, margins: tuple = MARGINS, levels: tuple = LEVELS) -> DataFrame:
    """One row per stratum: n good documents tested, the last valid step of the sequence (null: none), the losses there
    and their bound ln P, and the cutoff of every rule (null without a valid step)."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    r = rates()
    text = F.col("text_key") if "text_key" in counts.columns else F.xxhash64("doc_id")
    seen = counts.where(~base_failed()).select("doc_id", F.struct(text.alias("text_key"), "stratum", *(c.alias(k) for k, c in r.items())).alias("seen"))
    # a doc_id is one trial, and a text is: copies say nothing new, and would make the bound look safer than it is
    seen = seen.join(good.where("good = 1"), "doc_id").groupBy("doc_id").agg(F.min("seen").alias("seen")).select("seen.*").distinct()
    seen = seen.withColumn("half", F.xxhash64("text_key") % 2 == 0)
    quantiles = F.array(F.lit(1.0), *map(F.lit, levels))
    proposed = seen.where("half").groupBy("stratum").agg(*(F.percentile_approx(k, quantiles, 100_000).alias(k) for k in r))
    # cutoffs by step: margins of the greatest rate, then the quantiles
    steps = {k: F.concat(F.array(*(F.get(F.col(k), F.lit(0)) * m for m in margins)), F.slice(k, 2, len(levels))) for k in r}
    proposed = proposed.select(F.col("stratum").alias("s"), *(c.alias(f"p_{k}") for k, c in steps.items()))
    tested = seen.where("NOT half").join(small(proposed), F.col("stratum").eqNullSafe(F.col("s")))
    many = len(margins) + len(levels)
    beyond = lambda i: reduce(or_, (F.col(k) > F.get(f"p_{k}", F.lit(i)) for k in r))
    tested = tested.groupBy("stratum").agg(
        F.count("*").alias("n"), *(F.first(f"p_{k}").alias(f"p_{k}") for k in r), F.array(*(F.count_if(beyond(i)) for i in range(many))).alias("losses")
    )
    tests = saved(tested, "tests")
    least = F.log(F.lit(delta / max(1, tests.count())))
    steps = F.transform("losses", lambda x: log_binomial_cdf(x, F.col("n"), alpha))
    tests = tests.withColumn("bounds", steps)
    # how many steps are valid before the first that is not
    tests = tests.withColumn("step", F.coalesce(F.nullif(F.array_position(F.transform("bounds", lambda x: x > least), True), F.lit(0)) - 1, F.lit(many)) - 1)
    tests = tests.withColumn("step", F.when(F.col("step") >= 0, F.col("step")).cast("int"))
    at = lambda c: F.when(F.col("step").isNotNull(), F.get(c, F.col("step")))
    return tests.select("stratum", "n", "step", at("losses").alias("losses"), at("bounds").alias("log_p"), *(at(f"p_{k}").cast("double").alias(f"cut_{k}") for k in r))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; else Spark chooses."""
    return F.broadcast(df) if df.limit(FEW_STRATA + 1).count() <= FEW_STRATA else df


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed, kept and the rule that rejected (null: none) of every document."""
    counts = saved(base_counts(docs, stratum), "quality")
    cuts = saved(cutoffs(counts, labels, alpha, delta), "cutoffs")
    judged = counts.join(small(cuts.withColumnRenamed("stratum", "s")), F.col("stratum").eqNullSafe(F.col("s")), "left")
    fired = F.coalesce(*(F.when(c > F.col(f"cut_{k}"), F.lit(k)) for k, c in rates().items()))
    judged = judged.withColumn("rule", F.when(base_failed(), F.lit("base")).otherwise(fired))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), F.col("rule").isNull().alias("kept"), "rule",
    )
