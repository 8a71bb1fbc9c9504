"""Differential path usage: shares per cell type, divergence from uniform use, dominance, and a gene's score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def psi(counts: DataFrame) -> DataFrame:
    """Share of each path in its gene's total per cell type; cell types whose total is 0 have no row."""
    w = Window.partitionBy("gene_id", "cell_type")
    return counts.withColumn("total", F.sum("n").over(w)).where("total > 0").withColumn("psi", F.col("n") / F.col("total"))


def full_psi(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """psi over all paths of a gene in each of its cell types, with 0 for paths that were not seen."""
    seen = counts.groupBy("gene_id", "cell_type").agg(F.sum("n").alias("total")).where("total > 0")
    grid = seen.join(paths.select("gene_id", "path_id"), "gene_id")
    own = counts.groupBy("gene_id", "cell_type", "path_id").agg(F.sum("n").alias("n"))
    out = grid.join(own, ["gene_id", "cell_type", "path_id"], "left").fillna({"n": 0})
    return out.withColumn("psi", F.col("n") / F.col("total"))


def js_vs_uniform(shares: DataFrame, value: str = "psi") -> DataFrame:
    """Base-2 Jensen-Shannon divergence of each path's values over cell types from uniform; NULL with under two values.

    Values that sum to 0 have divergence 0.
    """
    w = Window.partitionBy("gene_id", "path_id")
    v = shares.where(F.col(value).isNotNull()).select("gene_id", "path_id", F.col(value).alias("v"))
    v = v.withColumn("k", F.count("*").over(w)).withColumn("s", F.sum("v").over(w))
    p, q = F.try_divide("v", "s"), 1 / F.col("k")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + q * F.log2(q / m)
    out = v.groupBy("gene_id", "path_id").agg(F.first("k").alias("k"), F.first("s").alias("s"), (F.sum(term) / 2).alias("js"))
    js = F.when(F.col("k") < 2, F.lit(None)).when(F.col("s") == 0, 0.0).otherwise(F.greatest(F.col("js"), F.lit(0.0)))
    return out.select("gene_id", "path_id", js.alias("js"))


def dominant_share(shares: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cell types that each path dominates; k paths within the tolerance of the greatest get 1/k each."""
    w = Window.partitionBy("gene_id", "cell_type")
    top = shares.withColumn("top", F.max("psi").over(w)).withColumn("tied", F.col("psi") >= F.col("top") - tolerance)
    each = F.when(F.col("tied"), 1 / F.sum(F.col("tied").cast("int")).over(w)).otherwise(0.0)
    out = top.withColumn("each", each).groupBy("gene_id", "path_id").agg(F.sum("each").alias("dominated"))
    return out.withColumn("qualified", F.col("dominated") >= 1 - tolerance)


def dtu_score(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """A gene's score: - sum of js * prop * log2(prop) over qualified paths, prop being their share of dominated types.

    0 with at most one qualified path, NULL with fewer than two cell types; genes of one path have no row.
    """
    shares = full_psi(counts, paths)
    types = shares.groupBy("gene_id").agg(F.count_distinct("cell_type").alias("types"), F.count_distinct("path_id").alias("paths"))
    both = js_vs_uniform(shares).join(dominant_share(shares), ["gene_id", "path_id"]).where("qualified")
    prop = F.col("dominated") / F.sum("dominated").over(Window.partitionBy("gene_id"))
    parts = both.withColumn("prop", prop).groupBy("gene_id").agg(
        F.count("*").alias("qualified"), F.sum(-F.col("js") * F.col("prop") * F.log2("prop")).alias("raw")
    )
    score = F.when(F.col("types") < 2, F.lit(None)).when(F.coalesce("qualified", F.lit(0)) <= 1, 0.0).otherwise(F.col("raw"))
    out = types.where("paths >= 2").join(parts, "gene_id", "left")
    return out.select("gene_id", F.coalesce("qualified", F.lit(0)).alias("n_qualified"), score.alias("dtu"))


def dtu_two_scopes(all_counts: DataFrame, train_counts: DataFrame, paths: DataFrame) -> DataFrame:
    """Scores over all cells and over training cells, full outer."""
    a = dtu_score(all_counts, paths).select("gene_id", F.col("dtu").alias("dtu_all"))
    b = dtu_score(train_counts, paths).select("gene_id", F.col("dtu").alias("dtu_train"))
    return a.join(b, "gene_id", "full")


def dtu_table(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """Per gene: paths, mean share of the dominant path, mean and sum of js, score, and `path:share` of dominance."""
    shares = full_psi(counts, paths)
    top = shares.groupBy("gene_id", "cell_type").agg(F.max("psi").alias("top")).groupBy("gene_id").agg(F.avg("top").alias("mean_top_psi"))
    parts = js_vs_uniform(shares).join(dominant_share(shares), ["gene_id", "path_id"])
    pair = F.struct("path_id", F.format_string("%s:%.4f", "path_id", "dominated").alias("said"))
    agg = parts.groupBy("gene_id").agg(
        F.count("*").alias("n_paths"), F.avg("js").alias("mean_js"), F.sum("js").alias("sum_js"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("qualified"), pair))), lambda x: x.said), ",").alias("distribution"),
    )
    return agg.join(top, "gene_id").join(dtu_score(counts, paths).select("gene_id", "dtu"), "gene_id")
