"""Permutation nulls, seeds, strata and paired reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import average_rank, hash32
from .audit import exact_quantiles
from .audit import multi_strata


def permutation_assignments(cells: DataFrame, b: int, least: int = 20) -> DataFrame:
    """b random permutations of the cells within each stratum (R1): permutation, stratum, target, source.

    The k-th cell by id receives from the k-th by hash. Strata under `least` cells are left out.
    """
    w = Window.partitionBy("stratum")
    d = cells.select("stratum", "cell_id").withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)
    d = d.withColumn("k", F.row_number().over(w.orderBy("cell_id"))).drop("n")
    # dealt anew, so that a stratum's permutations are not drawn in one task
    d = d.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stratum", "cell_id")
    p = d.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    h = Window.partitionBy("stratum", "permutation").orderBy(hash32("permutation", "stratum", "cell_id"), "cell_id")
    source = p.select("stratum", "permutation", F.col("cell_id").alias("source"), F.row_number().over(h).alias("k"))
    # both sides have b rows a cell, which Spark's sizes of an exploded table don't tell: never broadcast
    target = p.select("stratum", "permutation", F.col("cell_id").alias("target"), "k")
    return target.join(source.hint("merge"), ["stratum", "permutation", "k"]).drop("k")


def apply_permutation(values: DataFrame, assignments: DataFrame) -> DataFrame:
    """Whole rows of the sources under the targets' ids (R2)."""
    d = assignments.join(values.withColumnRenamed("cell_id", "source").hint("merge"), "source")
    return d.withColumnRenamed("target", "cell_id").drop("source")


def higher_quantile(x: str, q: float) -> Column:
    return F.element_at(F.sort_array(F.collect_list(x)), F.ceil(q * (F.count(x) - 1)).cast("int") + 1)


def aggregate_null(null: DataFrame, paired: DataFrame, least_positive: int = 95, q: float = 0.95) -> DataFrame:
    """Median over seeds per permutation against the paired gain (R3); an incomplete seed x permutation grid fails."""
    med = null.groupBy("permutation").agg(F.percentile("gain", F.lit(0.5)).alias("gain"), F.count_distinct("seed").alias("seeds"))
    out = med.agg(F.count("*").alias("permutations"), F.min("seeds").alias("least_seeds"), F.max("seeds").alias("most_seeds"), F.count_if(F.col("gain") > 0).alias("positive"), higher_quantile("gain", q).alias("null_q"))
    p = paired.agg(F.percentile("gain", F.lit(0.5)).alias("paired"))
    d = out.crossJoin(F.broadcast(p))
    complete = F.col("least_seeds") == F.col("most_seeds")
    status = F.when(~complete, "incomplete").when((F.col("positive") >= least_positive) & (F.col("paired") > F.col("null_q")), "pass").otherwise("fail")
    return d.withColumn("status", status)


def seed_attribution(df: DataFrame, keys: list[str], limit: float = 0.5) -> DataFrame:
    """Median, IQR, sign agreement and dispersion over seeds, with statuses of direction and size."""
    p = lambda v: F.percentile("value", F.lit(v))
    d = df.groupBy(*keys).agg(p(0.5).alias("median"), (p(0.75) - p(0.25)).alias("iqr"), F.count("*").alias("seeds"), F.abs(F.sum(F.signum("value"))).alias("net"))
    d = d.withColumns({"sign_agreement": (F.col("seeds") + F.col("net")) / (2 * F.col("seeds")), "dispersion": F.try_divide("iqr", F.abs("median"))})
    direction = F.when(F.col("sign_agreement") == 1, "consistent").otherwise("mixed")
    size = F.when(F.col("dispersion").isNull(), "not_estimable").when(F.col("dispersion") <= limit, "stable").otherwise("dispersed")
    return d.drop("net").withColumns({"direction": direction, "magnitude": size})


def pairwise_spearman(df: DataFrame, by: list[str]) -> DataFrame:
    """Spearman correlation of every pair of seeds per stratum on common records (R5). df: by, seed, record, value."""
    a = df.select(*by, "record", F.col("seed").alias("seed_a"), F.col("value").alias("x"))
    b = df.select(*by, "record", F.col("seed").alias("seed_b"), F.col("value").alias("y"))
    p = a.join(b, [*by, "record"]).where("seed_a < seed_b")
    keys = [*by, "seed_a", "seed_b"]
    p = p.withColumns({"rx": average_rank(F.col("x"), keys), "ry": average_rank(F.col("y"), keys)})
    flat = (F.count("*") < 2) | (F.min("rx") == F.max("rx")) | (F.min("ry") == F.max("ry"))
    return p.groupBy(*keys).agg(F.count("*").alias("records"), F.when(~flat, F.corr("rx", "ry")).alias("spearman"))


def between_state(df: DataFrame, states: list[str]) -> DataFrame:
    """Medians per state and seed, the contrast of the first two, and whether all seeds agree in sign."""
    m = df.groupBy("seed").pivot("state", states).agg(F.percentile("value", F.lit(0.5)))
    m = m.withColumn("contrast", F.col(states[0]) - F.col(states[1]))
    every = m.agg(F.min("contrast").alias("lo"), F.max("contrast").alias("hi"))
    d = m.crossJoin(F.broadcast(every))
    return d.withColumn("status", F.when((F.col("lo") > 0) | (F.col("hi") < 0), "agreed").otherwise("mixed")).drop("lo", "hi")


def seed_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample sd, least and greatest of each metric over seeds."""
    long = df.unpivot(["seed"], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("greatest"))


def manifest_coverage(eligible: DataFrame, selected: DataFrame, keys: list[str], scopes: list[list[str]]) -> DataFrame:
    """Selected over eligible by scope."""
    d = eligible.join(selected.select(*keys).distinct().withColumn("_s", F.lit(1)), keys, "left")
    return multi_strata(d, scopes, [F.count("*").alias("eligible"), F.count("_s").alias("selected"), (F.count("_s") / F.count("*")).alias("share")])


def compare_models(rows: DataFrame, by: list[str], epsilon: float) -> DataFrame:
    """Paired mean differences a - b by stratum and seed; a claim needs more than epsilon in every seed.

    rows: record, seed, model (a or b), value, by.
    """
    p = rows.groupBy("record", "seed", *by).agg(F.max(F.when(F.col("model") == "a", F.col("value"))).alias("a"), F.max(F.when(F.col("model") == "b", F.col("value"))).alias("b"))
    d = p.groupBy(*by, "seed").agg(F.avg(F.col("a") - F.col("b")).alias("gain"), F.count("*").alias("records"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unpaired"))
    return d.groupBy(*by).agg(F.min("gain").alias("least_gain"), F.avg("gain").alias("mean_gain"), F.sum("unpaired").alias("unpaired")).withColumn("claim", F.col("least_gain") > epsilon)


def axis_strata(df: DataFrame, axes: list[str], by: list[str], numerator: str, denominator: str, means: list[str]) -> DataFrame:
    """For every axis and level: ratio of sums and NULL-aware means."""
    long = df.withColumns({a: F.col(a).cast("string") for a in axes}).withColumn("_ax", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes))))
    return long.groupBy("_ax.axis", "_ax.level", *by).agg(F.count("*").alias("rows"), F.try_divide(F.sum(numerator), F.sum(denominator)).alias("ratio"), *(F.avg(m).alias(f"mean_{m}") for m in means))


def path_count_bin(n: Column) -> Column:
    """Bins of path counts."""
    return F.when(n <= 2, "2").when(n == 3, "3").when(n <= 5, "4-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise(">20")


def log2_bin(n: Column) -> Column:
    return F.when(n > 0, F.floor(F.log2(n)).cast("int"))


def support_sensitivity(df: DataFrame, keys: dict[str, list | DataFrame], metrics: list[str]) -> DataFrame:
    """Macro and weighted means for every cell of a grid; empty cells stay as not_estimable (R13). df: keys, weight, metrics.

    Levels of a key are a list, or (for one key) a table of one column. The weighted mean of a cell without weight is NULL.
    """
    grid = next((x.toDF(k) for k, x in keys.items() if isinstance(x, DataFrame)), None)
    grid = df.sparkSession.range(1).select() if grid is None else grid
    for k, levels in keys.items():
        if not isinstance(levels, DataFrame):
            grid = grid.withColumn(k, F.explode(F.array(*map(F.lit, levels))))
    long = df.unpivot([*keys, "weight"], metrics, "metric", "value")
    own = long.where("value IS NOT NULL").groupBy(*keys, "metric").agg(F.count("*").alias("rows"), F.avg("value").alias("macro"), F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("weighted"))
    every = grid.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    d = every.join(own, [*keys, "metric"], "left").fillna({"rows": 0})
    return d.withColumn("status", F.when(F.col("rows") > 0, "estimable").otherwise("not_estimable"))


def quantile_bins(df: DataFrame, x: str, k: int) -> DataFrame:
    """Bins at exact linear quantiles, the first closed on the left; equal edges merge."""
    named = {f"q{i}": i / k for i in range(k + 1)}
    edges = exact_quantiles(df, [], x, named).select(F.array_distinct(F.array(*(F.col(f"{c}.linear") for c in named))).alias("edges"))
    d = df.crossJoin(F.broadcast(edges))
    return d.withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col(x))), F.lit(1)) - 1).drop("edges")


def stratified_gap(genes: DataFrame, top: float = 0.1) -> DataFrame:
    """Gap b - a over fixed, overlapping strata of the score, and the share of mass (R15). genes: gene_id, dtu, a, b, mass."""
    x = F.col("dtu")
    cut = exact_quantiles(genes, [], "dtu", {"q": 1 - top}).select(F.col("q.linear").alias("cut")).crossJoin(genes.agg(F.sum("mass").alias("all_mass")))
    named = [(x == 0, "=0"), ((x > 0) & (x <= 0.1), "(0,.1]"), ((x > 0.1) & (x <= 0.35), "(.1,.35]"), ((x > 0.35) & (x <= 0.65), "(.35,.65]"), (x > 0.65, ">.65"), (x >= F.col("cut"), "top")]
    d = genes.crossJoin(F.broadcast(cut)).withColumn("stratum", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))))
    gap = F.col("b") - F.col("a")
    return d.groupBy("stratum").agg(F.count("*").alias("genes"), F.avg(gap).alias("macro_gap"), (F.sum(gap * F.col("mass")) / F.sum("mass")).alias("weighted_gap"), (F.sum("mass") / F.first("all_mass")).alias("mass_share"))


def bootstrap_ci(df: DataFrame, x: str, b: int, seed: int) -> DataFrame:
    """95 % interval of the mean by resampling rows with a portable hash (R16). df: i (dense 0-based index), x.

    Draws are (replicate, draw) pairs hashed to an index; the join on the index is an equi-join, without a sort of the
    draws. Rows are dealt anew before they are multiplied, so that a small file's draws are not made in one task.
    """
    n = df.agg(F.count("*").alias("n"))
    draws = df.select("i").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).crossJoin(F.broadcast(n)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    draws = draws.select("rep", (hash32(F.lit(seed), "rep", "i") % F.col("n")).alias("i"))
    means = draws.join(df.select("i", F.col(x).alias("x")).hint("shuffle_hash"), "i").groupBy("rep").agg(F.avg("x").alias("m"))
    p = lambda q: F.percentile("m", F.lit(q))
    out = means.agg(p(0.025).alias("lo"), p(0.975).alias("hi")).crossJoin(df.agg(F.avg(x).alias("mean")))
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def epoch_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two run histories by epoch: gap of the metric, and epochs at which the first one's rate fell."""
    w = Window.orderBy("epoch")  # one row per epoch
    d = a.join(b.select("epoch", F.col("metric").alias("metric_b")), "epoch")
    return d.select("epoch", (F.col("metric_b") - F.col("metric")).alias("gap"), F.coalesce(F.col("rate") < F.lag("rate").over(w), F.lit(False)).alias("rate_drop"))
