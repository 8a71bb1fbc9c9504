"""Column closure, ridge and resampling against dense numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions.core import hash32
from tallgrass.operators import metrics, regress


def sparse(spark, x, names):
    rows = [(int(i), names[j], float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "route_id int, column string, value double").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_n6_keeps_the_columns_that_numpy_keeps(spark, seed):
    rng = np.random.default_rng(seed)
    x = (rng.random((300, 14)) < 0.2) * rng.integers(-3, 4, (300, 14)).astype(float)
    x[:, 9] = x[:, 1] + x[:, 2]
    x[:, 11] = 2 * x[:, 5] - x[:, 9]
    x[:, 12] = 0
    x[:, 0] = x[:, 13]
    names = [f"c{i:02}" for i in range(14)]
    factors = {"c13", "c05"}
    got = {r.column: r.status for r in regress.closed_columns(sparse(spark, x, names), names, factors).collect()}
    order = [c for c in names if c in factors] + [c for c in names if c not in factors]
    kept: list[int] = []
    for c in order:
        i = names.index(c)
        more = np.linalg.matrix_rank(x[:, [*kept, i]]) > len(kept)
        want = "zero" if not x[:, i].any() else "kept" if more else "redundant"
        assert got[c] == want, c
        if more:
            kept.append(i)
    assert got["c13"] == "kept" and got["c00"] == "redundant" and got["c12"] == "zero"


def test_n6_merges_triangles_in_a_tree_and_refuses_unknown_columns(spark, monkeypatch):
    monkeypatch.setattr(regress, "FAN_IN", 2)
    monkeypatch.setattr(regress, "BLOCK_ROWS", 7)
    x = np.random.default_rng(1).normal(size=(90, 5))
    r = regress.triangle(sparse(spark, x, list("abcde")), list("abcde"))
    assert np.allclose(r.T @ r, x.T @ x)
    with pytest.raises(Exception, match="unknown column"):
        regress.triangle(sparse(spark, x, list("abcde")), list("abcd"))
    with pytest.raises(ValueError, match="at most"):
        regress.triangle(sparse(spark, x, list("abcde")), [str(i) for i in range(5000)])


def dense(rows, numbers, categories, levels):
    columns = [[r[c] for r in rows] for c in numbers] + [[float(r[c] == level) for r in rows] for c in categories for level in levels[c]]
    return np.array(columns, float).T


def test_m15_equals_a_dense_weighted_ridge(spark):
    rng = random.Random(3)
    rows = [{"k": i, "m": rng.random(), "n": rng.randint(1, 9), "g": rng.choice("abc"), "d": rng.choice("xy"), "s": rng.choice("pq"), "w": rng.random() + 0.1} for i in range(400)]
    for r in rows:
        r["y"] = r["m"] + (r["g"] == "a") - 2 * (r["s"] == "p") + rng.gauss(0, 0.3)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'int' if k in 'kn' else 'string' if k in 'gds' else 'double'}" for k in rows[0])).repartition(6)
    designs = {"nuisance": (["m", "n"], ["g", "d"]), "state": (["m", "n"], ["g", "d", "s"])}
    alphas = [1000.0, 0.5, 0.5, 0.0]
    fits = regress.ridge_designs(df, designs, "y", "w", "k", alphas)
    fold = {r.k: r.f for r in df.select("k", (hash32("k") % 3).alias("f")).collect()}
    f = np.array([fold[r["k"]] for r in rows])
    w, y = (np.array([r[c] for r in rows]) for c in "wy")
    for name, (numbers, categories) in designs.items():
        x = dense(rows, numbers, categories, {"g": "abc", "d": "xy", "s": "pq"})

        def fitted(at, alpha, x=x):
            xm, ym = np.average(x[at], axis=0, weights=w[at]), np.average(y[at], weights=w[at])
            c = x[at] - xm
            b = np.linalg.lstsq(c.T @ (c * w[at, None]) + alpha * np.eye(x.shape[1]), c.T @ (w[at] * (y[at] - ym)), rcond=None)[0]
            return x @ b + ym - xm @ b

        want = [np.mean([np.average((y - fitted(f != k, a))[f == k] ** 2, weights=w[f == k]) for k in range(3)]) for a in alphas]
        fit = fits[name]
        assert np.allclose([s for _, s in fit.scores], want, rtol=1e-7)
        assert fit.alpha == alphas[int(np.argmin(np.round(want, 10)))]
        said = {r.k: r.prediction for r in fit.predicted(df).collect()}
        assert np.allclose([said[r["k"]] for r in rows], fitted(np.ones(len(rows), bool), fit.alpha), atol=1e-7)
    assert min(s for _, s in fits["state"].scores) < 0.5 * min(s for _, s in fits["nuisance"].scores)
    report = regress.ridge_report(fits, spark)
    assert report.count() == 8
    with pytest.raises(Exception, match="unseen level"):
        fits["state"].predicted(df.withColumn("s", F.lit("new"))).collect()


def test_m15_refuses_bad_rows(spark):
    df = spark.createDataFrame([(i, float(i), "a", 1.0 if i else 0.0, 0.5) for i in range(20)], "k int, m double, g string, w double, y double")
    with pytest.raises(Exception, match="positive weights"):
        regress.ridge_designs(df, {"x": (["m"], ["g"])}, "y", "w", "k", [1.0])
    with pytest.raises(ValueError, match="strengths"):
        regress.ridge_designs(df, {"x": (["m"], ["g"])}, "y", "w", "k", [-1.0])


def test_r16_equals_a_local_replay_and_shuffles_no_draws(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(1, 2, (1000, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double")
    b, size = 50, 64
    counts = np.hstack([regress.row_counts(5, 1000, k, size, b) for k in range(-(-1000 // size))])
    assert (counts.sum(1) == 1000).all()
    for parts in (2, 7):
        got = regress.bootstrap_sums(df.repartition(parts), ["a", "b", "c"], b, 5, size).orderBy("rep").collect()
        assert np.allclose([[r.n, r.a, r.b, r.c] for r in got], np.column_stack([np.full(b, 1000), counts @ x]))
    # draws are a bootstrap's: mean 1 and variance near 1 - 1/n per row, for rows of one block and of several
    many = np.hstack([regress.row_counts(1, 1000, k, size, 2000) for k in range(16)])
    assert abs(many.mean() - 1) < 1e-12 and abs(many.var(0).mean() - 0.999) < 0.01
    assert abs(np.corrcoef(many[:, :64].sum(1), many[:, 64:128].sum(1))[0, 1] + 64 / (1000 - 64)) < 0.06


def test_r16_intervals(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0.5, 1, 600)
    rows = [(i, float(v), float(v) * 2, 1.0 + i % 3) for i, v in enumerate(x)]
    got = {r.statistic: r for r in regress.resampled_intervals(spark.createDataFrame(rows, "i long, a double, b double, c double"), "a", "b", "c").collect()}
    half = 1.96 * x.std() / len(x) ** 0.5
    assert abs(got["mean"].point - x.mean()) < 1e-12 and abs(got["mean"].lo - (x.mean() - half)) < 0.15 * half and abs(got["mean"].hi - (x.mean() + half)) < 0.15 * half
    assert got["mean"].significant and abs(got["ratio"].point - 2 * x.sum() / sum(r[3] for r in rows)) < 1e-12


def test_m16_gate_of_two_fits(spark):
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.choice("ab"), rng.choice("pq"), 1.0 + rng.random()) for i in range(600)]
    df = spark.createDataFrame([(i, m, g, s, w, m + 3 * (s == "p") + rng.gauss(0, 0.2), m + rng.gauss(0, 0.2), i % 4 == 0) for i, m, g, s, w in rows], "k int, m double, g string, s string, w double, y double, z double, high boolean")
    for label, status in (("y", "fail"), ("z", "pass")):
        fits = regress.ridge_designs(df.where("k % 2 = 0"), {"n": (["m"], ["g"]), "s": (["m"], ["g", "s"])}, label, "w", "k", [0.1])
        got = {r.stratum: r for r in metrics.residual_gate(fits["n"], fits["s"], df.where("k % 2 = 1").withColumn("high", F.col("k") % 5 == 0), label, "w", "high").collect()}
        assert got.keys() == {"overall", "high_dtu"} and {r.status for r in got.values()} == {status}
        none = {r.stratum: r.status for r in metrics.residual_gate(fits["n"], fits["s"], df.where("k % 2 = 1").withColumn("high", F.lit(False)), label, "w", "high").collect()}
        assert none == {"overall": status, "high_dtu": "not_estimable"}
