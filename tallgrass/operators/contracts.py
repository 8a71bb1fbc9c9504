"""Contracts as tables of violations: an empty result means that the contract holds (Q1-Q9, Q13, Q14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import reasons
from ..sources.shared import cut


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often (Q1)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_parents(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct child keys without a parent (Q2); the parent must pass duplicates()."""
    return child.select(*keys).distinct().join(parent.select(*keys).distinct(), keys, "left_anti")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with the side they are missing on (Q3)."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("extra")))


def bad_levels(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Values outside a vocabulary, NULL included, with their rows (Q4)."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("rows"))


def bad_numbers(df: DataFrame, keys: list[str], column: str, integer: bool = False) -> DataFrame:
    """Rows whose number is NULL, not finite, negative or (with `integer`) fractional, with the reasons (Q5)."""
    x = F.col(column).cast("double")
    infinite = F.isnan(x) | (F.abs(x) == float("inf"))
    why = reasons((x.isNull(), "null"), (infinite, "not_finite"), (x < 0, "negative"), (F.lit(integer) & ~infinite & (x != F.floor(x)), "fractional"))
    return df.select(*keys, F.array_join(why, ",").alias("reasons")).where("reasons <> ''")


def varying(df: DataFrame, unit: list[str], columns: list[str]) -> DataFrame:
    """Units within which a column takes several values, NULL counting as a value (Q6)."""
    agg = [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0null"))).alias(f"n_{c}") for c in columns]
    return df.groupBy(*unit).agg(*agg).where(" OR ".join(f"n_{c} > 1" for c in columns))


def unmatched_scope(df: DataFrame, group: str, keys: list[str], invariants: list[str]) -> DataFrame:
    """Keys that not all groups share, or on which an invariant differs between groups (Q7)."""
    total = df.agg(F.count_distinct(group).alias("total"))
    by = df.groupBy(*keys).agg(F.count_distinct(group).alias("n_groups"), F.count_distinct(F.struct(*invariants)).alias("n_values"))
    return by.crossJoin(F.broadcast(total)).where("n_groups <> total OR n_values > 1").select(*keys, "n_groups", "n_values")


def conserved(df: DataFrame, whole: Column, parts: list[Column], by: list[str]) -> DataFrame:
    """Per stratum: sums of the whole and of the parts, rows that differ, and whether all are equal (Q8)."""
    rest = sum(parts[1:], parts[0])
    return df.groupBy(*by).agg(
        F.sum(whole).alias("whole"), F.sum(rest).alias("parts"), F.sum((whole != rest).cast("int")).alias("rows_off"), F.bool_and(whole == rest).alias("holds")
    )


def ec_violations(ec: DataFrame, legal: DataFrame) -> DataFrame:
    """Reasons against each evidence row (Q9): ec has gene_id, key columns, paths ARRAY, mass, fate; legal gene_id, axis ARRAY.

    Checked are the gene, the mass, that paths are a duplicate-free subset of the axis in its order, and the fate.
    """
    r = ec.join(legal, "gene_id", "left")
    at = F.transform("paths", lambda p: F.array_position("axis", p))
    n, total = F.size("paths"), F.size("axis")
    fate = F.when(n == 0, "empty").when(n == total, "full").otherwise("informative")
    why = reasons(
        (F.col("axis").isNull(), "unknown_gene"),
        (~F.coalesce(F.col("mass") > 0, F.lit(False)), "mass_not_positive"),
        (F.exists(at, lambda k: k == 0), "illegal_path"),
        (F.size(F.array_distinct("paths")) < n, "repeated_path"),
        (at != F.array_sort(at), "not_in_axis_order"),
        (F.col("fate") != fate, "fate_differs"),
    )
    return r.withColumn("reasons", F.array_join(why, ",")).drop("axis")


def rebound(ec: DataFrame, split: DataFrame) -> DataFrame:
    """Replaces a stale split by the authoritative one; cells without a split have NULL, to be caught by missing_parents (Q13)."""
    return ec.drop("split").join(split.select("cell_id", "split"), "cell_id", "left")


def canonical_order(ec: DataFrame, axis: DataFrame) -> DataFrame:
    """Sets in the axis' order, with the 0-based places; source order stays in `paths` (Q14)."""
    r = ec.join(axis, "gene_id")
    return r.withColumn("ordered", F.filter("axis", lambda a: F.array_contains("paths", a))).withColumn(
        "places", F.filter(F.sequence(F.lit(0), F.size("axis") - 1), lambda i: F.array_contains("paths", F.get("axis", i)))
    ).drop("axis")


def numbered(df: DataFrame, order: list[str], name: str = "i") -> DataFrame:
    """A dense 0-based index in a total order over all rows, without a single-task window.

    Rows are range-partitioned and written with their partition's number, since ranges may be drawn anew in another run
    of the plan; each partition's offset is a sum over partition counts (one number each).
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = sizes.alias("a").join(sizes.alias("b"), F.col("b._p") < F.col("a._p"), "left").groupBy(F.col("a._p").alias("_p")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_o"))
    return dealt.withColumn("_k", own).join(F.broadcast(offset), "_p").withColumn(name, (F.col("_o") + F.col("_k") - 1).cast("long")).drop("_p", "_k", "_o")


def provenance(matrix: DataFrame, compat: DataFrame, overlap: DataFrame) -> DataFrame:
    """Two one-row descriptions side by side (Q11): equal cells, matrix = overlap + rest, and the admission status."""
    d = matrix.withColumnRenamed("cells", "matrix_cells").crossJoin(compat.withColumnRenamed("cells", "compat_cells")).crossJoin(overlap)
    d = d.withColumns({"matrix_only": F.col("matrix_cells") - F.col("overlap"), "compat_only": F.col("compat_cells") - F.col("overlap"), "same_cells": F.col("matrix_cells") == F.col("compat_cells")})
    closes = F.col("matrix_cells") == F.col("overlap") + F.col("matrix_only")
    return d.withColumn("matrix_closes", closes).withColumn("status", F.when(F.col("same_cells") & closes, "ADMITTED").otherwise("PENDING"))


def dtu_provenance(meta: DataFrame) -> DataFrame:
    """Genes whose scores were not made on training cells only, have no source, or come twice (Q12)."""
    n = F.count("*").over(Window.partitionBy("gene_id"))
    why = reasons((~F.col("scope").eqNullSafe("train_only"), "scope"), (F.col("source").isNull(), "no_source"), (n > 1, "repeated"))
    return meta.select("gene_id", F.array_join(why, ",").alias("reasons")).where("reasons <> ''")


def validate_dataset(counts: DataFrame, paths: DataFrame, split: DataFrame, ec: DataFrame) -> DataFrame:
    """Number of violations of each contract between the tables of a dataset (Q10)."""
    one = lambda name, d: d.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_"), "violations")
    checks = [
        one("counts_without_path", counts.join(paths.select("path_id"), "path_id", "left_anti")),
        one("counts_without_cell", counts.join(split.select("cell_id"), "cell_id", "left_anti")),
        one("paths_repeated", duplicates(paths, ["path_id"])),
        one("cells_repeated", duplicates(split, ["cell_id"])),
        one("bad_split", bad_levels(split, "split", ["train", "val", "test"])),
        one("mass_not_positive", ec.where(~F.coalesce(F.col("mass") > 0, F.lit(False)))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
