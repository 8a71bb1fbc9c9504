"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash32(*parts) -> Column:
    """A portable hash, 0 to 2^32 - 1: the first eight hex digits of the SHA-256 of the parts joined by |."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def short_id(prefix: str, text: Column, n: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, n))


def top_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every group in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def ordered_sum(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """(keys, value): the sum of every group, added up in a given order, so that each reading gives the same bits.

    A plain sum of doubles takes partial sums as they come; groups of the same values then differ in their last bit.
    A group's rows are summed as they pass, and may be spilled.
    """
    w = Window.partitionBy(*keys).orderBy(*order, value)
    d = df.select(*keys, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"), F.row_number().over(w).alias("_k"))
    return d.groupBy(*keys).agg(F.max_by("_sum", "_k").alias(value))


def average_rank(value: Column, keys: list[str]) -> Column:
    """Ranks from 1 in which ties share their mean rank."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(w.partitionBy(*keys, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(w))


def effective_size(w: Column) -> Column:
    return F.try_divide(F.pow(F.sum(w), F.lit(2)), F.sum(w * w))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)))


def guarded(fault: Column) -> Column:
    """A filter that is true, or an error with the text of the fault where there is one."""
    return F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))
