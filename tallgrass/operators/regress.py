"""Small dense algebra over many rows: column closure by a tree of QRs, ridge from sums of folds, resampling by trees.

Rows stay in Spark's tasks; what a task gives away has a size that columns, folds or replicates bound, whatever the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import hash32
from ..sources.shared import cut

#: Columns of a design, at most; more are an error, since a triangle of them goes through single tasks and the driver.
MOST_COLUMNS = 2048
#: Triangles that one task of the next level merges, and rows of a dense block.
FAN_IN, BLOCK_ROWS = 16, 4096


def _checked(k: int) -> int:
    if k > MOST_COLUMNS:
        raise ValueError(f"{k} columns; at most {MOST_COLUMNS} can be closed or fitted in one design")
    return k


def triangle(design: DataFrame, order: list[str]) -> np.ndarray:
    """R of the QR decomposition of a sparse design (route_id, column, value), columns in the given order.

    Each task reduces its rows to one triangle, a block at a time; triangles are merged in a tree. Cells of columns that
    `order` lacks are an error.
    """
    spark, k = design.sparkSession, _checked(len(order))
    places = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "column string, place int")
    place = F.coalesce("place", F.raise_error(F.concat(F.lit("unknown column "), F.col("column"))).cast("int"))
    rows = design.join(F.broadcast(places), "column", "left").withColumn("place", place)
    rows = rows.groupBy("route_id").agg(F.collect_list("place").alias("places"), F.collect_list(F.col("value").cast("double")).alias("values"))

    def upper(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(parts), mode="r")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = np.zeros((part.num_rows, k))
                places, sizes = part.column(0).flatten().to_numpy(), part.column(0).value_lengths().to_numpy()
                np.add.at(x, (np.repeat(np.arange(part.num_rows), sizes), places), part.column(1).flatten().to_numpy())
                r = upper([r, x])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()])], names=["r"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, k))
        for b in batches:
            for x in b.column(0):
                r = upper([r, np.frombuffer(x.as_py()).reshape(-1, k)])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()])], names=["r"])

    level = cut(rows.select("places", "values").mapInArrow(first, "r binary"))
    n = level.count()
    while n > 1:
        n = -(-n // FAN_IN)
        level = cut(level.repartition(n).mapInArrow(merged, "r binary"))
        n = level.count()
    found = level.collect()
    return np.frombuffer(found[0].r).reshape(-1, k) if found else np.zeros((0, k))


def closed_columns(design: DataFrame, order: list[str], factors: set[str] = frozenset(), tolerance: float = 1e-9) -> DataFrame:
    """(column, status) of a design's columns (N6): kept, zero, or redundant given the kept ones before it.

    Columns of `factors` come first, then the others, each in the given order; so a factor is never dropped for another
    column. A column is redundant if what the kept ones leave of it is at most `tolerance` of its own length, or of 1.
    """
    order = [c for c in order if c in factors] + [c for c in order if c not in factors]
    r = triangle(design, order)
    basis, out = np.zeros((0, len(r))), []
    for i, c in enumerate(order):
        x = r[:, i]
        rest = x - basis.T @ (basis @ x)
        rest = rest - basis.T @ (basis @ rest)  # once more, against the rounding of the first time
        size = np.linalg.norm(rest)
        if not np.linalg.norm(x) > 0:
            out.append((c, "zero"))
        elif size <= tolerance * max(np.linalg.norm(x), 1.0):
            out.append((c, "redundant"))
        else:
            basis = np.vstack([basis, rest / size])
            out.append((c, "kept"))
    return design.sparkSession.createDataFrame(out, "column string, status string")


@dataclass
class Ridge:
    """A frozen ridge fit: names and coefficients of its columns, levels of its categories, and the scores of all strengths."""

    names: list[str]
    coefficients: np.ndarray
    intercept: float
    alpha: float
    levels: dict[str, list[str]]
    numbers: list[str]
    scores: list[tuple[float, float]] = field(default_factory=list)  # (alpha, mean of the folds' weighted squared errors)

    def predicted(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """rows with the prediction; a level that the fit has not seen is an error."""
        value = F.lit(self.intercept)
        of = dict(zip(self.names, self.coefficients.tolist(), strict=True))
        for c in self.numbers:
            value = value + of[c] * F.col(c).cast("double")
        for c, levels in self.levels.items():
            known = F.create_map(*(F.lit(x) for level in levels for x in (level, of[f"{c}={level}"])))
            value = value + F.coalesce(F.try_element_at(known, F.col(c).cast("string")), _unseen(c))
        return rows.withColumn(name, value)


def _unseen(c: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{c} has an unseen level "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))).cast("double")


def fold_sums(rows: DataFrame, numbers: list[str], levels: dict[str, list[str]], label: str, weight: str, fold: Column, folds: int) -> np.ndarray:
    """Z'WZ per fold, Z being a column of ones, the numbers, a column per level, and the label: one Spark job."""
    at = {name: k for k, name in enumerate([*numbers, *(f"{c}={level}" for c in levels for level in levels[c])], 1)}
    k, categories = len(at) + 2, [*levels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((folds, k, k))
        for b in batches:
            for start in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[start : start + BLOCK_ROWS]
                z = np.zeros((len(part), k))
                z[:, 0], z[:, -1] = 1, part["_y"]
                for i, c in enumerate(numbers, 1):
                    z[:, i] = part[f"_n{i}"]
                for i, c in enumerate(categories):
                    place = part[f"_c{i}"].map(lambda level, c=c: at.get(f"{c}={level}", -1)).to_numpy()
                    if (place < 0).any():
                        raise ValueError(f"{c} has an unseen level")
                    z[np.arange(len(part)), place] = 1
                w = part["_w"].to_numpy()
                if not (np.isfinite(z).all() and np.isfinite(w).all() and (w > 0).all()):
                    raise ValueError("ridge needs finite numbers and labels, and positive weights")
                for f in range(folds):
                    mine = (part["_f"] == f).to_numpy()
                    sums[f] += (z[mine] * w[mine, None]).T @ z[mine]
        f, i, j = np.nonzero(np.triu(sums))
        yield pd.DataFrame({"f": f, "i": i, "j": j, "v": sums[f, i, j]})

    given = [F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numbers, 1)] + [F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(f"_c{i}") for i, c in enumerate(categories)]
    d = rows.select(*given, F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), fold.cast("int").alias("_f"))
    parts = d.mapInPandas(run, "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((folds, k, k))
    for r in parts:
        out[r.f, r.i, r.j] = out[r.f, r.j, r.i] = r.v
    return out


def _solved(s: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients from Z'WZ, the first of them (of the ones) not penalised."""
    a = s[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * (len(s) - 2))
    return np.linalg.lstsq(a, s[:-1, -1], rcond=None)[0]


def _loss(s: np.ndarray, beta: np.ndarray) -> float:
    """Weighted mean of squared errors over the rows of the sums."""
    v = np.append(beta, -1.0)
    return float(v @ s @ v) / s[0, 0]


def ridge_designs(
    rows: DataFrame, designs: dict[str, tuple[list[str], list[str]]], label: str, weight: str, key: str, alphas: list[float], folds: int = 3
) -> dict[str, Ridge]:
    """Weighted ridge fits of several designs (numbers, categories), each with its strength by cross-validation.

    Folds are drawn by a portable hash of `key`; of equal mean losses the first strength of the grid wins. Rows are read
    twice, for the levels and for the sums of all designs' columns; every strength, fold and design is solved from these.
    """
    if folds < 2 or not alphas or any(not 0 <= a < float("inf") for a in alphas):
        raise ValueError("ridge needs two folds or more and finite strengths of 0 or more")
    numbers = list(dict.fromkeys(c for n, _ in designs.values() for c in n))
    categories = list(dict.fromkeys(c for _, n in designs.values() for c in n))
    named = F.array(*(F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias("level")) for c in categories))
    found = rows.select(F.explode(named).alias("x")).select("x.*").distinct().limit(MOST_COLUMNS + 1).collect() if categories else []
    _checked(len(found) + len(numbers))
    levels = {c: sorted(r.level for r in found if r.c == c) for c in categories}
    sums = fold_sums(rows, numbers, levels, label, weight, hash32(key) % folds, folds)
    if not (sums[:, 0, 0] > 0).all():
        raise ValueError("a fold has no rows")
    names = ["", *numbers, *(f"{c}={level}" for c in categories for level in levels[c]), label]
    out = {}
    for design, (n, c) in designs.items():
        mine = {*n, *(f"{x}={level}" for x in c for level in levels[x])}
        keep = [0, *(i for i, name in enumerate(names) if 0 < i < len(names) - 1 and name in mine), len(names) - 1]
        s = sums[np.ix_(range(folds), keep, keep)]
        scores = [(a, float(np.mean([_loss(s[f], _solved(s.sum(0) - s[f], a)) for f in range(folds)]))) for a in map(float, alphas)]
        best = min(range(len(scores)), key=lambda k: (scores[k][1], k))
        beta = _solved(s.sum(0), scores[best][0])
        out[design] = Ridge([names[i] for i in keep[1:-1]], beta[1:], float(beta[0]), scores[best][0], {x: levels[x] for x in c}, [x for x in numbers if x in n], scores)
    return out


def ridge_report(fits: dict[str, Ridge], spark) -> DataFrame:
    """(design, alpha, mean_loss, chosen) of all strengths."""
    rows = [(d, a, loss, a == fit.alpha) for d, fit in fits.items() for a, loss in fit.scores]
    return spark.createDataFrame(rows, "design string, alpha double, mean_loss double, chosen boolean")


def _generator(seed: int, *node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(int.from_bytes(hashlib.sha256("|".join(map(str, (seed, *node))).encode()).digest()[:16], "big")))


def block_draws(seed: int, n: int, block: int, size: int, b: int) -> np.ndarray:
    """How many of the n draws of each of b replicates fall into a block of rows, by splitting binomials from all blocks on.

    Each split is drawn by a generator of its own, named by seed and range: so that every worker draws the same, and
    needs only the splits above its block.
    """
    lo, hi, left = 0, -(-n // size), np.full(b, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = (mid - lo) * size / (min(hi * size, n) - lo * size)
        first = _generator(seed, lo, hi).binomial(left, share)
        lo, hi, left = (lo, mid, first) if block < mid else (mid, hi, left - first)
    return left


def row_counts(seed: int, n: int, block: int, size: int, b: int) -> np.ndarray:
    """Draws of every row of a block in every replicate: (b, rows)."""
    rows = min(size, n - block * size)
    draws, rng = block_draws(seed, n, block, size, b), _generator(seed, block)
    place = rng.integers(0, rows, int(draws.sum()))
    return np.bincount(np.repeat(np.arange(b), draws) * rows + place, minlength=b * rows).reshape(b, rows)


def bootstrap_sums(df: DataFrame, columns: list[str], b: int, seed: int, size: int = 512) -> DataFrame:
    """(rep, n, one sum per column) of b resamples of all rows (R16). df: i (dense index from 0) and the columns.

    Rows are grouped in blocks of `size` neighbours in the index; a block draws its rows' counts itself and gives b sums,
    which are added up over the blocks. No draw is shuffled.
    """
    n = df.count()
    names = ["rep", "n", *columns]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = rows.sort_by("i")
        x = np.column_stack([np.ones(part.num_rows), *(part[c].to_numpy() for c in columns)])
        sums = row_counts(seed, n, key[0].as_py(), size, b) @ x
        return pa.table([pa.array(range(b), pa.int32()), *(pa.array(sums[:, k]) for k in range(len(columns) + 1))], names=names)

    d = df.select("i", *(F.col(c).cast("double").alias(c) for c in columns), F.floor(F.col("i") / size).cast("long").alias("block"))
    parts = d.groupBy("block").applyInArrow(run, "rep int, " + ", ".join(f"{c} double" for c in names[1:]))
    return parts.groupBy("rep").agg(*(F.sum(c).alias(c) for c in names[1:]))


def resampled_intervals(df: DataFrame, value: str, part: str, whole: str, b: int = 4000, seed: int = 5) -> DataFrame:
    """95 % intervals of the mean of `value` and of the ratio of sums part / whole over resampled rows.

    Rows: statistic, point, lo, hi, significant (the interval leaves out 0). Percentiles are linear, over b numbers.
    """
    sums = cut(bootstrap_sums(df, [value, part, whole], b, seed))
    mean, ratio = F.sum(value) / F.count("*"), F.sum(part) / F.sum(whole)
    point = df.select(*(F.col(c).cast("double").alias(c) for c in (value, part, whole))).agg(mean.alias("mean"), ratio.alias("ratio"))
    each = F.array(F.struct(F.lit("mean").alias("statistic"), (F.col(value) / F.col("n")).alias("x")), F.struct(F.lit("ratio").alias("statistic"), (F.col(part) / F.col(whole)).alias("x")))
    by = sums.select(F.explode(each).alias("s")).select("s.*").groupBy("statistic").agg(F.percentile("x", F.lit(0.025)).alias("lo"), F.percentile("x", F.lit(0.975)).alias("hi"))
    points = point.select(F.explode(F.create_map(F.lit("mean"), "mean", F.lit("ratio"), "ratio")).alias("statistic", "point"))
    return by.join(points, "statistic").select("statistic", "point", "lo", "hi", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))
