"""Mixing sources to target weights with soft domain membership, in DataFrame functions.

A classifier (multinomial logistic regression on hashed word frequencies, Spark ML) learns domains from a labelled
table, on a bounded sample of it (TRAIN_DOCS documents by hash), and gives every document posteriors over the domains.
Document rates w >= 0 are fitted so that the expected token totals, sum of w * tokens * posterior, match the targets:

    minimise  1/2 sum_d (sum_i w_i m_i p_id - t_d)^2 + PULL/2 sum_i m_i (w_i - budget)^2,   0 <= w_i <= max_rate

with m_i the document's share of all tokens. Projected gradient steps, scaled by 1/m_i, are
w <- clip(w - (sum_d r_d p_d + PULL (w - budget))) with the residuals r_d of all documents. A step depends on a document
through its posteriors only, so posteriors are rounded to 1/GRID and documents with equal ones are summed once into
cells; each step is one aggregation of the cells to one number per domain, and a rate is a fold over the residuals of
all steps. Nothing but these few numbers reaches the driver, and no per-step table is written.

A rate becomes whole copies: its integer part, and one more where a hash of doc_id falls below the fraction.

Defined cases: a null text has no tokens and the classifier's prior; labels with null doc_id or domain are ignored, of
several labels of a document the least counts; with one labelled domain it has posterior 1, with none all posteriors
are 0 and the rate is the budget; a target without labels cannot be met; repeated rows get equal rates; an empty table
gives an empty result; extra columns pass through, output names that clash get a trailing underscore.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

TRAIN_DOCS, HASHED, GRID = 20_000, 4096, 64
STEPS, PULL, ENOUGH = 80, 1e-3, 1e-4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def classifier(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS):
    """(fitted pipeline or None, domains in order). labels: doc_id, domain."""
    known = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = known.groupBy("domain").count().orderBy("domain").collect()  # a row per domain
    domains, total = [r.domain for r in counts], sum(r["count"] for r in counts)
    if len(domains) < 2:
        return None, domains
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, train_docs / total) * (1 << 30))
    number = F.coalesce(*(F.when(F.col("domain") == d, F.lit(float(k))) for k, d in enumerate(domains)))
    few = F.broadcast(known.where(drawn))  # about train_docs rows of two columns
    sample = docs.where(drawn).join(few, "doc_id").select(words(F.col("text")).alias("_words"), "domain")
    sample = saved(sample.select("_words", number.alias("label")), "labelled")
    steps = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=HASHED),
        Normalizer(inputCol="_tf", outputCol="_features", p=2.0),
        LogisticRegression(featuresCol="_features", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_said", family="multinomial", maxIter=25, regParam=1e-4),
    ]
    return (Pipeline(stages=steps).fit(sample) if sample.limit(1).count() else None), domains


def posteriors(docs: DataFrame, model, domains: list[str]) -> DataFrame:
    """docs with _p (array of posteriors in multiples of 1/GRID, by domain) and _n (tokens)."""
    ready = docs.withColumn("_words", words(F.col("text")))
    if model is None:
        return ready.select(*docs.columns, F.array(*(F.lit(1.0) for _ in domains)).cast("array<double>").alias("_p"), F.size("_words").cast("long").alias("_n"))
    said = model.transform(ready)
    rounded = F.transform(vector_to_array("_p"), lambda p: F.round(p * GRID) / GRID)
    return said.select(*docs.columns, rounded.alias("_p"), F.size("_words").cast("long").alias("_n"))


def rate(p: Column, history: list[list[float]], budget: float, max_rate: float) -> Column:
    """A document's rate after the steps whose residuals are in `history`."""
    if not history:
        return F.lit(min(budget, max_rate))
    steps = F.array(*(F.array(*map(F.lit, r)) for r in history))

    def step(w: Column, r: Column) -> Column:
        slope = F.aggregate(F.zip_with(r, p, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.greatest(F.lit(0.0), F.least(F.lit(max_rate), w - slope - PULL * (w - budget)))

    return F.aggregate(steps, F.lit(min(budget, max_rate)), step)


def fitted(cells: DataFrame, goal: list[float], budget: float, max_rate: float, steps: int = STEPS) -> list[list[float]]:
    """Residuals by step. cells: _p, n (tokens); goal: target totals over all tokens, by domain."""
    total = cells.agg(F.sum("n")).first()[0] or 0
    history: list[list[float]] = []
    for _ in range(steps if total and goal else 0):
        w = cells.select("n", "_p", rate(F.col("_p"), history, budget, max_rate).alias("w"))
        got = w.agg(*(F.sum(F.col("w") * F.col("n") * F.get("_p", F.lit(d))).alias(f"d{d}") for d in range(len(goal)))).first()
        residual = [round(got[d] / total - goal[d], 12) for d in range(len(goal))]
        if max(map(abs, residual)) < ENOUGH:
            break
        history.append(residual)
    return history


def copies_of(w: Column, doc_id: Column, seed: int) -> Column:
    share = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(w) + F.when(share < w - F.floor(w), 1).otherwise(0)).cast("int")


def mixed(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float = 1.0, max_rate: float = 4.0,
    seed: int = 1,
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """docs with n_tokens, posterior (array by domain), rate and copies; and the domains in order.

    targets: the wanted share of each domain's expected tokens (brought to a sum of 1); budget: wanted tokens over all
    tokens; keep: columns of docs to carry (doc_id among them; all by default). The scored rows are written to the
    shared folder once, since cells and rates both read them.
    """
    model, domains = classifier(docs, labels)
    names = fresh(docs, "n_tokens", "posterior", "rate", "copies")
    keep = docs.columns if keep is None else keep
    judged = saved(posteriors(docs, model, domains).select(*keep, "_p", "_n"), "posteriors")
    cells = saved(judged.groupBy("_p").agg(F.sum("_n").alias("n")), "cells")
    whole = sum(targets.values()) or 1.0
    history = fitted(cells, [budget * targets.get(d, 0.0) / whole for d in domains], budget, max_rate)
    out = judged.withColumn("_w", F.round(rate(F.col("_p"), history, budget, max_rate), 9))
    return out.select(
        *keep,
        F.col("_n").alias(names[0]),
        F.col("_p").alias(names[1]),
        F.col("_w").alias(names[2]),
        copies_of(F.col("_w"), F.col("doc_id"), seed).alias(names[3]),
    ), domains
