import random

import numpy as np
from pyspark.sql import functions as F

from tallgrass.llm import mixing


def corpus():
    rng = random.Random(4)
    rows, labels = [(-1, None), (-2, "")], []
    for i in range(900):
        d = "abc"[min(2, i % 5)]
        pool = {"a": ["sun", "sea", "sky"], "b": ["iron", "coal", "tin"], "c": ["war", "mud", "ash"]}[d] + ["the", "of", "and"]
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(20, 60)))))
        if i % 2:
            labels.append((i, d))
    return rows, labels


def test_expected_totals_meet_the_targets(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, rate string")
    out, domains = mixing.mixed(docs, spark.createDataFrame(labels, "doc_id long, domain string"), {"a": 0.5, "b": 0.3, "c": 0.2}, budget=0.5)
    assert domains == ["a", "b", "c"] and out.count() == 902
    total = out.agg(F.sum("n_tokens")).first()[0]
    got = out.agg(*(F.sum(F.col("rate_") * F.col("n_tokens") * F.get("posterior", F.lit(k))) for k in range(3))).first()
    assert np.allclose(np.array(got) / total, [0.25, 0.15, 0.1], atol=0.005)
    assert out.where("rate_ < 0 OR copies < 0 OR rate <> 'clash'").count() == 0
    kept = out.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert abs(kept / total - 0.5) < 0.05


def test_rates_equal_a_dense_solution(spark):
    rng = np.random.default_rng(1)
    p, n = np.round(rng.dirichlet([0.4, 0.4, 0.4], 200) * 64) / 64, rng.integers(5, 50, 200)
    cells = spark.createDataFrame([(x.tolist(), int(m)) for x, m in zip(p, n, strict=True)], "_p array<double>, n long")
    goal = [0.3, 0.2, 0.1]
    history = mixing.fitted(cells, goal, 0.7, 1.5, steps=40)
    w, m = np.full(200, 0.7), n / n.sum()
    for _ in history:
        r = (w * m) @ p - goal
        w = np.clip(w - p @ r - mixing.PULL * (w - 0.7), 0, 1.5)
    got = cells.select("_p", mixing.rate(F.col("_p"), history, 0.7, 1.5).alias("w")).collect()
    want = {tuple(a): b for a, b in zip(p.tolist(), w, strict=True)}
    assert all(abs(want[tuple(r._p)] - r.w) < 1e-6 for r in got)


def test_few_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, "x"), (3, None)], "doc_id long, domain string")
    out, domains = mixing.mixed(docs, none, {"x": 1.0}, budget=0.5)
    assert domains == [] and [r.rate for r in out.collect()] == [0.5] * 3
    out, domains = mixing.mixed(docs, spark.createDataFrame([(1, "x")], "doc_id long, domain string"), {"x": 1.0}, budget=1.0)
    assert domains == ["x"] and {r.copies for r in out.collect()} == {1}
    assert mixing.mixed(docs.where("doc_id > 5"), none, {"x": 1.0})[0].collect() == []
