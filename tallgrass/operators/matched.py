"""Reports over matched records that fail closed: what would bias a comparison in silence is an error."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import guarded
from .audit import exact_quantiles, multi_strata

#: Parts of column names that give away outcomes or support of held-out records.
OUTCOME_NAMES = ["test_effect", "effect_magnitude", "delta_rho", "prediction_correct", "test_nll", "support_tier", "direct_cell_supported"]


def _not_finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def matched_scope(records: DataFrame, group: list[str], key: list[str], same: list[str], label: str) -> DataFrame:
    """The records, if every group (as a model and a seed) has every key once, and `same` columns do not differ within a key."""
    none = F.when(reduce(or_, (F.col(c).isNull() for c in [*group, *key])), F.lit(f"{label}: a key is null"))
    records = records.where(guarded(none))
    totals = records.agg(F.count_distinct(F.struct(*group)).alias("_groups"))
    by = records.groupBy(*key).agg(F.count("*").alias("_n"), F.count_distinct(F.struct(*group)).alias("_k"), (F.min(F.struct(F.lit(0), *same)) != F.max(F.struct(F.lit(0), *same))).alias("_differs"))
    say = lambda text: F.lit(f"{label}: {text}")
    fault = F.when(F.col("_n") != F.col("_k"), say("a record is repeated")).when(F.col("_k") != F.col("_groups"), say("records differ between groups")).when(F.col("_differs"), say("a fixed column differs between groups"))
    ok = by.crossJoin(F.broadcast(totals)).select(*key, guarded(fault).alias("_ok"))  # one row of totals
    return records.join(ok, key).where("_ok").drop("_ok")


def with_strata(records: DataFrame, strata: DataFrame, key: str, label: str) -> DataFrame:
    """Records with the columns of a frozen table that must have one row for each of their keys."""
    once = strata.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in strata.columns if c != key))
    d = records.join(once, key, "left")
    fault = F.when(F.col("_n").isNull(), F.lit(f"{label}: a record has no stratum")).when(F.col("_n") > 1, F.lit(f"{label}: strata are repeated"))
    return d.where(guarded(fault)).drop("_n")


def _axes(axes: list[str], overall: bool) -> Column:
    first = [F.struct(F.lit("overall").alias("axis"), F.lit("overall").alias("level"))] if overall else []
    return F.explode(F.array(*first, *(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes)))


def state_contrasts(df: DataFrame, by: list[str], pairs: list[tuple[str, str]], least_cells: int, epsilon: float, floor: float, most_dispersed: float) -> DataFrame:
    """Contrasts of the states' medians per record over seeds, with the first reason against a stable one.

    df: seed, cell_id, state, value and by. The cells of a state must be the same in every seed. A contrast needs
    `least_cells` cells on both sides, one direction beyond epsilon in all seeds, a median of at least `floor`, and an
    interquartile range of at most `most_dispersed` medians.
    """
    d = matched_scope(df, ["seed"], [*by, "state", "cell_id"], [], "state contrasts")
    cells = d.groupBy(*by, "state").agg(F.count_distinct("cell_id").alias("cells"))
    median = exact_quantiles(d, [*by, "state", "seed"], "value", {"m": 0.5}).select(*by, "state", "seed", F.col("m.linear").alias("m"))
    per = median.groupBy(*by, "state").agg(F.array_sort(F.collect_list(F.struct("seed", "m"))).alias("seeds")).join(cells, [*by, "state"])
    names = F.array(*(F.struct(F.lit(a).alias("state_a"), F.lit(b).alias("state_b")) for a, b in pairs))
    every = d.select(*by).distinct().select(*by, F.explode(names).alias("pair")).select(*by, "pair.*")
    side = lambda x: per.select(*by, F.col("state").alias(f"state_{x}"), F.col("cells").alias(f"cells_{x}"), F.col("seeds").alias(f"seeds_{x}"))
    every = every.join(side("a"), [*by, "state_a"], "left").join(side("b"), [*by, "state_b"], "left").fillna({"cells_a": 0, "cells_b": 0})
    enough = F.least("cells_a", "cells_b") >= least_cells
    every = every.withColumn("contrasts", F.when(enough, F.zip_with("seeds_a", "seeds_b", lambda x, y: x.m - y.m)))
    middle, spread = _linear("contrasts", 0.5), _linear("contrasts", 0.75) - _linear("contrasts", 0.25)
    every = every.withColumns({"median": middle, "dispersion": spread / F.greatest(F.abs(middle), F.lit(floor))})
    one_way = F.forall("contrasts", lambda x: x > epsilon) | F.forall("contrasts", lambda x: x < -epsilon)
    status = (
        F.when(~enough, "not_estimable").when(~one_way, "direction_not_stable").when(F.abs("median") < floor, "below_floor").when(F.col("dispersion") > most_dispersed, "magnitude_not_stable")
    ).otherwise("stable")
    return every.select(*by, "state_a", "state_b", "cells_a", "cells_b", "contrasts", "median", "dispersion", status.alias("status"))


def _linear(c: str, q: float) -> Column:
    """A linear quantile of a small array."""
    x, place = F.array_sort(c), F.lit(q) * (F.size(c) - 1)
    low, high = F.get(x, F.floor(place).cast("int")), F.get(x, F.ceil(place).cast("int"))
    return low + (high - low) * (place - F.floor(place))


def checked_coverage(eligible: DataFrame, selected: DataFrame, keys: list[str], scopes: list[list[str]]) -> DataFrame:
    """Selected over eligible by scope (R8). A selection outside the eligible records, or one that carries outcomes, is an error."""
    seen = [c for c in selected.columns if any(name in c.lower() for name in OUTCOME_NAMES)]
    if seen:
        raise ValueError(f"the selection has columns of outcomes: {seen}")
    chosen = selected.select(*keys).distinct().withColumn("_s", F.lit(1))
    d = eligible.withColumn("_e", F.lit(1)).join(chosen, keys, "full")
    d = d.where(guarded(F.when(F.col("_e").isNull(), "a selected record is not eligible")))
    return multi_strata(d, scopes, [F.count("*").alias("eligible"), F.count("_s").alias("selected"), (F.count("_s") / F.count("*")).alias("share")])


def compare_readouts(records: DataFrame, a: str, b: str, axes: list[str]) -> DataFrame:
    """Two models on the same records, by seed, axis and level: likelihoods, gain of a, calibration of both.

    records: seed, model, cell_id, gene_id, ec_id, mass, nll_sum, calibration and axes. Both models must have every record
    once per seed, with equal mass and axes, and finite numbers; other models are an error.
    """
    fault = F.when(~F.col("model").isin(a, b) | F.col("model").isNull(), "readouts: another model").when(_not_finite("mass") | (F.col("mass") <= 0) | _not_finite("nll_sum") | (F.col("nll_sum") < 0) | _not_finite("calibration"), "readouts: a number is not valid")
    d = matched_scope(records.where(guarded(fault)), ["seed", "model"], ["cell_id", "gene_id", "ec_id"], ["mass", *axes], "readouts")
    d = d.withColumn("_at", _axes(axes, True))
    of = lambda m, x: F.sum(F.when(F.col("model") == m, x).cast("double"))
    mine = lambda m: F.count_if(F.col("model") == m)
    out = d.groupBy("seed", "_at.axis", "_at.level").agg(
        *((of(m, F.col("nll_sum")) / of(m, F.col("mass"))).alias(f"nll_{k}") for k, m in (("a", a), ("b", b))),
        *((of(m, F.col("calibration")) / mine(m)).alias(f"calibration_{k}") for k, m in (("a", a), ("b", b))),
        *((of(m, F.col("calibration") * F.col("mass")) / of(m, F.col("mass"))).alias(f"weighted_calibration_{k}") for k, m in (("a", a), ("b", b))),
        mine(a).alias("rows"),
        of(a, F.col("mass")).alias("mass"),
    )
    return out.withColumn("gain", F.col("nll_b") - F.col("nll_a"))


def readout_claim(compared: DataFrame, epsilon: float) -> DataFrame:
    """Whether a is better by more than epsilon in every seed, over all records."""
    d = compared.where("axis = 'overall'")
    return d.agg(F.count("*").alias("seeds"), F.min("gain").alias("least_gain"), F.avg("gain").alias("mean_gain"), F.bool_and(F.col("gain") > epsilon).alias("claim"))


def prediction_strata(records: DataFrame, strata: DataFrame, axes: list[str], means: list[str]) -> DataFrame:
    """Likelihood and means by model, seed, axis and level, each cell and gene once.

    records: model, seed, cell_id, gene_id, mass, nll_sum and means; strata: gene_id and axes, one row per gene.
    """
    bad = reduce(or_, map(_not_finite, ["mass", "nll_sum", *means])) | (F.col("mass") <= 0) | (F.col("nll_sum") < 0)
    d = matched_scope(records.where(guarded(F.when(bad, "predictions: a number is not valid"))), ["model", "seed"], ["cell_id", "gene_id"], ["mass"], "predictions")
    d = with_strata(d, strata, "gene_id", "predictions").withColumn("_at", _axes(axes, False))
    return d.groupBy("model", "seed", "_at.axis", "_at.level").agg(
        F.count("*").alias("rows"), F.count_distinct("gene_id").alias("genes"), F.sum("mass").alias("mass"), (F.sum("nll_sum") / F.sum("mass")).alias("nll"), *(F.avg(m).alias(f"mean_{m}") for m in means)
    )


def attribution_strata(records: DataFrame, strata: DataFrame, axes: list[str]) -> DataFrame:
    """Medians of effects and counts of stable ones by model, axis and level, each record once.

    records: model, cell_id, gene_id, record_id, median, iqr, dispersion, direction, magnitude, primary.
    """
    key = ["model", "cell_id", "gene_id", "record_id"]
    bad = reduce(or_, map(_not_finite, ["median", "iqr", "dispersion"]))
    d = records.withColumn("_times", F.count("*").over(Window.partitionBy(*key)))
    d = d.where(guarded(F.when(F.col("_times") > 1, "attributions: a record is repeated").when(bad, "attributions: a number is not valid"))).where("primary")
    d = with_strata(d, strata, "gene_id", "attributions").withColumn("_at", _axes(axes, False)).select("*", "_at.axis", "_at.level", F.abs("median").alias("_size"))
    by = ["model", "axis", "level"]
    out = d.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_distinct("cell_id", "gene_id").alias("cell_genes"),
        F.count_if(F.col("direction") == "consistent").alias("direction_stable"), F.count_if(F.col("magnitude") == "stable").alias("magnitude_stable"),
    )
    for name, c in (("median_size", "_size"), ("median_iqr", "iqr"), ("median_dispersion", "dispersion")):
        out = out.join(exact_quantiles(d, by, c, {"q": 0.5}).select(*by, F.col("q.linear").alias(name)), by)
    return out


def seed_sensitivity(records: DataFrame, assignments: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics per model, seed, support bin and high or other genes: macro and count-weighted, over the whole grid.

    records: model, seed, cell_id, gene_id, high, total and metrics (NULL where not defined); assignments: gene_id,
    stratifier, bin, bin_order, one row per gene and stratifier. Empty cells stay, as not estimable.
    """
    bad = F.col("high").isNull() | _not_finite("total") | (F.col("total") <= 0) | reduce(or_, (F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")), F.lit(False)) for m in metrics))
    d = matched_scope(records.where(guarded(F.when(bad, "sensitivity: a number is not valid"))), ["model", "seed"], ["cell_id", "gene_id"], ["high", "total"], "sensitivity")
    w = Window.partitionBy("gene_id", "stratifier")
    frozen = assignments.withColumn("_n", F.count("*").over(w)).where(guarded(F.when(F.col("_n") > 1, F.lit("sensitivity: a gene has two bins")))).drop("_n")
    # in the columns themselves: the grid's join would filter NULLs away before a guard beside them sees them
    none = F.raise_error(F.lit("sensitivity: a gene has no bin"))
    d = d.join(frozen, "gene_id", "left").withColumns({c: F.coalesce(c, none.cast(frozen.schema[c].dataType)) for c in ("stratifier", "bin", "bin_order")})
    key = ["model", "seed", "stratifier", "bin", "bin_order", "high", "metric"]
    long = d.select("model", "seed", "stratifier", "bin", "bin_order", "high", "gene_id", "total", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("_m")).select("*", "_m.*").drop("_m")
    valid = F.col("value").isNotNull()
    own = long.groupBy(*key).agg(
        F.count_distinct("gene_id").alias("genes"), F.count("*").alias("rows"), F.sum("total").cast("double").alias("mass"), F.count("value").alias("defined"),
        F.avg("value").alias("_macro"), F.try_divide(F.sum(F.col("value") * F.col("total")), F.sum(F.when(valid, F.col("total")))).alias("_weighted"),
    )
    # the grid: models and seeds by frozen bins, two small vocabularies
    grid = records.select("model", "seed").distinct().crossJoin(F.broadcast(assignments.select("stratifier", "bin", "bin_order").distinct()))
    grid = grid.withColumn("high", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    every = grid.join(own, key, "left").fillna({"genes": 0, "rows": 0, "mass": 0.0, "defined": 0})
    kinds = F.explode(F.array(F.struct(F.lit("macro").alias("aggregation"), F.col("_macro").alias("value")), F.struct(F.lit("weighted").alias("aggregation"), F.col("_weighted").alias("value"))))
    every = every.withColumn("_k", kinds).select("*", "_k.*").drop("_k", "_macro", "_weighted")
    return every.withColumn("status", F.when(F.col("value").isNotNull(), "estimable").otherwise("not_estimable"))


def across_seeds(per_seed: DataFrame) -> DataFrame:
    """Mean, sample sd and range of seed_sensitivity's values over seeds (R13); denominators must not differ between them."""
    key = ["model", "stratifier", "bin", "bin_order", "high", "metric", "aggregation"]
    counts = ["genes", "rows", "mass", "defined"]
    estimable = F.bool_and(F.col("status") == "estimable")
    only = lambda x: F.when(estimable, x)
    d = per_seed.groupBy(*key).agg(
        F.count("*").alias("seeds"), only(F.avg("value")).alias("mean"), only(F.stddev_samp("value")).alias("sd"), only(F.max("value") - F.min("value")).alias("range"),
        (F.min(F.struct(*counts)) != F.max(F.struct(*counts))).alias("_differs"), *(F.min(c).alias(c) for c in counts),
        F.when(estimable, "estimable").otherwise("not_estimable").alias("status"),
    )
    return d.where(guarded(F.when(F.col("_differs"), "sensitivity: denominators differ between seeds"))).drop("_differs")
