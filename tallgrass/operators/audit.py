"""Strata, waterfalls, conserved masses and weighted statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import effective_size, weighted_mean
from ..sources.shared import cut


def multi_strata(df: DataFrame, strata: list[list[str]], metrics: list[Column]) -> DataFrame:
    """The metrics over each set of columns in one pass (grouping sets), with stratum_type and stratum_values (A1)."""
    columns = list(dict.fromkeys(c for s in strata for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in strata], *map(F.col, columns)).agg(*metrics, F.grouping_id(*map(F.col, columns)).alias("_g"))

    def code(s: list[str]) -> int:
        return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)

    kind = F.coalesce(*(F.when(F.col("_g") == code(s), F.lit("x".join(s) or "global")) for s in strata))
    values = F.coalesce(*(F.when(F.col("_g") == code(s), F.array(*(F.col(c).cast("string") for c in s)).cast("array<string>")) for s in strata))
    rest = [c for c in grouped.columns if c not in (*columns, "_g")]
    return grouped.select(kind.alias("stratum_type"), values.alias("stratum_values"), *rest)


def fate_waterfall(ec: DataFrame, by: list[str], fates: list[str], universe: DataFrame | None = None) -> DataFrame:
    """Rows, mass and share of the stratum's mass for every stratum and every fate; NULL share and a status where it has none (A2)."""
    strata = (universe if universe is not None else ec).select(*by).distinct()
    grid = strata.crossJoin(F.broadcast(ec.sparkSession.createDataFrame([(f,) for f in fates], "fate string")))
    own = ec.groupBy(*by, "fate").agg(F.count("*").alias("rows"), F.sum("mass").alias("mass"))
    out = grid.join(own, [*by, "fate"], "left").fillna({"rows": 0, "mass": 0})
    total = F.sum("mass").over(Window.partitionBy(*by))
    return out.withColumns({"fraction": F.try_divide("mass", F.when(total > 0, total)), "status": F.when(total > 0, "estimable").otherwise("not_estimable")})


def opportunity_audit(molecules: DataFrame, by: list[str]) -> DataFrame:
    """Masses of supported and censored opportunities, over QC-pass mass (A3). molecules: qc_pass, mass, supported, censored."""
    q = F.col("qc_pass")
    pick = lambda c: F.sum(F.when(q & c, F.col("mass")).otherwise(0))
    out = molecules.groupBy(*by).agg(
        F.sum("mass").alias("captured"), pick(F.lit(True)).alias("qc_mass"), pick(F.col("supported") > 0).alias("supported_mass"),
        pick(F.col("censored") > 0).alias("censored_mass"), F.sum(F.when(q, F.col("supported") * F.col("mass")).otherwise(0)).alias("supported_opportunities"),
    )
    return out.withColumn("supported_fraction", F.col("supported_mass") / F.when(F.col("qc_mass") > 0, F.col("qc_mass")))


def partial_merge(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Adds up partial audits by stratum and says whether captured = qc + technical still holds (A4)."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums)).withColumn("conserved", F.col("captured") == F.col("qc_mass") + F.col("technical"))


def qc_status(df: DataFrame, performed: Column, passed: Column, total: Column) -> DataFrame:
    """A fraction only where the check was performed; NULL and a status elsewhere, never 0 (A5)."""
    return df.withColumns({"fraction": F.when(performed & (total > 0), passed / total), "status": F.when(~performed, "not_performed").when(total == 0, "empty").otherwise("performed")})


def cumulative_coverage(df: DataFrame, by: list[str], steps: dict[str, Column]) -> DataFrame:
    """Rows that pass the first, the first two, ... conditions."""
    agg, all_of = [F.count("*").alias("eligible")], F.lit(True)
    for name, c in steps.items():
        all_of = all_of & F.coalesce(c, F.lit(False))
        agg.append(F.count_if(all_of).alias(name))
    return df.groupBy(*by).agg(*agg)


def weighted_moments(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """Weighted mean, population variance and Kish effective size (A7); two passes, so that the variance keeps its digits."""
    mean = df.groupBy(*by).agg(weighted_mean(F.col(x), F.col(w)).alias("mean"))
    both = df.join(mean, by)
    return both.groupBy(*by).agg(F.first("mean").alias("mean"), weighted_mean(F.pow(F.col(x) - F.col("mean"), F.lit(2)), F.col(w)).alias("variance"), effective_size(F.col(w)).alias("n_eff"))


def weighted_quantile(df: DataFrame, by: list[str], x: str, w: str, q: float) -> DataFrame:
    """The first value in ascending order whose cumulative weight reaches q of all."""
    g = Window.partitionBy(*by)
    d = df.where(f"{w} > 0").groupBy(*by, x).agg(F.sum(w).alias(w))
    d = d.withColumn("cum", F.sum(w).over(g.orderBy(x))).withColumn("all", F.sum(w).over(g))
    return d.groupBy(*by).agg(F.min(F.when(F.col("cum") >= q * F.col("all"), F.col(x))).alias("quantile"))


def ranked_values(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, x, n, to, total): every value with its rows, the rows up to it in ascending order, and all of its group.

    Values are counted first, dealt out by range and summed with their partition's offset, so that no group meets in one
    task. NULLs are left out.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange(*by, x).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "_p").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = sizes.select(*by, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(*by)).alias("total"))
    own = F.sum("n").over(Window.partitionBy(*by, "_p").orderBy(x))
    d = dealt.withColumn("_own", own)
    same = [d[c].eqNullSafe(sizes[c]) for c in by] + [d["_p"] == sizes["_p"]]
    return d.join(sizes, reduce(and_, same)).select(*(d[c] for c in by), d[x], "n", (F.col("_o") + F.col("_own")).alias("to"), "total")


def exact_quantiles(df: DataFrame, by: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """(by, name ...): a struct (linear, higher) for every named quantile; a group without values has no row."""
    d = ranked_values(df, by, x).withColumn("x", F.col(x).cast("double"))
    at = lambda r: F.max(F.when((F.col("to") - F.col("n") <= r) & (r < F.col("to")), F.col("x")))
    out = []
    for name, q in qs.items():
        place = F.lit(q) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append(F.struct((low + (high - low) * part).alias("linear"), high.alias("higher")).alias(name))
    return d.groupBy(*by).agg(*out)


def quantiles(df: DataFrame, by: list[str], x: str, q: float) -> DataFrame:
    """Linear and "higher" quantile, median and interquartile range."""
    d = exact_quantiles(df, by, x, {"q": q, "q25": 0.25, "q50": 0.5, "q75": 0.75})
    return d.select(*by, "q.linear", "q.higher", F.col("q50.linear").alias("median"), (F.col("q75.linear") - F.col("q25.linear")).alias("iqr"))


def weighted_r2(df: DataFrame, by: list[str], y: str, predicted: str, w: str) -> DataFrame:
    """1 - weighted residual over weighted total sum of squares; NULL without variance (A10)."""
    mean = df.groupBy(*by).agg(weighted_mean(F.col(y), F.col(w)).alias("m"))
    d = df.join(F.broadcast(mean), by)  # a row per stratum; a shuffle by strata would bring all rows to a few tasks
    sq = lambda a, b: F.sum(F.col(w) * F.pow(F.col(a) - F.col(b), F.lit(2)))
    out = d.groupBy(*by).agg(sq(y, predicted).alias("rss"), sq(y, "m").alias("tss"))
    return out.select(*by, F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")).alias("r2"))


def pooled_counts(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Path counts by cell type."""
    return counts.join(cells.select("cell_id", "cell_type"), "cell_id").groupBy("cell_type", "path_id").agg(F.sum("n").alias("n"))


def gene_counts(counts: DataFrame) -> DataFrame:
    """Counts and positive paths by gene and cell."""
    return counts.groupBy("gene_id", "cell_id").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("positive_paths"))


def fate(paths: Column, legal: Column) -> Column:
    """What a set of compatible paths says."""
    return F.when(F.size(paths) == 0, "empty").when(F.size(paths) == legal, "full").otherwise("informative")


def duplicate_molecules(molecules: DataFrame, keys: list[str]) -> DataFrame:
    """Primary records that share cell, gene and molecule; a failure, never dropped in silence."""
    return molecules.groupBy(*keys).agg(F.count("*").alias("records")).where("records > 1")


def aggregate_ec(molecules: DataFrame, keys: list[str]) -> DataFrame:
    """Equivalence classes with their molecule counts and ids numbered within the gene in the keys' order."""
    by = molecules.groupBy("gene_id", *keys).agg(F.count("*").alias("molecule_count"))
    number = F.row_number().over(Window.partitionBy("gene_id").orderBy(*keys))
    return by.withColumn("class_id", F.format_string("ec:%s:%08d", F.col("gene_id"), number))


def cell_gene_mass(molecules: DataFrame) -> DataFrame:
    """Captured, technical and per-fate masses (C10). molecules: cell_id, gene_id, qc_pass, fate."""
    some = lambda c: F.count_if(c)
    q = F.col("qc_pass")
    return molecules.groupBy("cell_id", "gene_id").agg(
        F.count("*").alias("captured"), some(q).alias("qc_mass"), some(~q).alias("technical"),
        *(some(q & (F.col("fate") == f)).alias(f"{f}_mass") for f in ("empty", "informative", "full")),
    )


def reconcile(cell_gene: DataFrame, counts: DataFrame) -> DataFrame:
    """Evidence masses beside matrix counts: 0 where the matrix has none, a scope and a relation."""
    m = gene_counts(counts).select("gene_id", "cell_id", F.col("n").alias("matrix"), "positive_paths")
    r = cell_gene.join(m, ["gene_id", "cell_id"], "left").fillna({"matrix": 0, "positive_paths": 0})
    scope = F.when(F.col("matrix") == 0, "zero_total").when(F.col("positive_paths") < 2, "under_two_positive").otherwise("eligible")
    d = F.col("matrix") - F.col("captured")
    return r.withColumns({"scope": scope, "relation": F.when(d == 0, "equal").when(d > 0, "matrix_above").otherwise("matrix_below"), "difference": d})


def equivalence_patterns(ec: DataFrame) -> DataFrame:
    """Distinct informative training patterns with rows and mass (C14)."""
    return ec.where("split = 'train' AND fate = 'informative'").groupBy("gene_id", "paths_key").agg(F.count("*").alias("row_count"), F.sum("mass").alias("mass"))
