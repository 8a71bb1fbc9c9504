"""Nearest rows by blocks, shared runs by hashes and gate thresholds against brute force."""

import math
import random

import pytest

from tallgrass.operators import context, identify


def test_x3_blocks_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = lambda n: [(i, rng.choice("ab"), [float(rng.randint(0, 3)) for _ in range(3)]) for i in range(n)]
    q, a = rows(60), rows(90)
    q += [(100, None, [0.0, 0.0, 0.0]), (101, "a", None), (102, "only", [1.0, 1.0, 1.0])]
    kind = "stratum string, v array<double>"
    got = context.knn_map(spark.createDataFrame(q, f"query_id long, {kind}"), spark.createDataFrame(a, f"neighbor_id int, {kind}"), 4, 7)
    want = []
    for i, s, v in q:
        near = sorted((math.dist(v, w), j) for j, t, w in a if v and s == t)[:4]
        want += [(i, s, j, r, round(d, 9)) for r, (d, j) in enumerate(near, 1)]
    assert sorted((r.query_id, r.stratum, r.neighbor_id, r["rank"], round(r.distance, 9)) for r in got.collect()) == sorted(want)
    few = context.knn_map(spark.createDataFrame(q, f"query_id long, {kind}"), spark.createDataFrame([*a, (900, "only", [1.0, 1.0, 1.0])], f"neighbor_id int, {kind}"), 4, 7)
    assert few.where("stratum = 'only'").count() == 0 and few.count() == len(want)
    strata = context.knn_strata(spark.createDataFrame(q, f"query_id long, {kind}"), spark.createDataFrame([*a, (900, "only", [1.0, 1.0, 1.0])], f"neighbor_id int, {kind}"), 4)
    assert {r.stratum: r.reason for r in strata.collect()} == {"a": "queries_without_vector", "b": None, "only": "fewer_atlas_rows_than_k", None: "no_stratum"}
    empty = spark.createDataFrame([], f"neighbor_id int, {kind}")
    assert context.knn_map(spark.createDataFrame(q, f"query_id long, {kind}"), empty, 4).count() == 0


def test_x3_leaves_out_blocks_that_hold_no_neighbour(spark):
    rng = random.Random(6)
    centres = [[rng.uniform(-50, 50) for _ in range(4)] for _ in range(9)]
    rows = lambda n: [(i, rng.choice("ab"), [x + rng.gauss(0, 1) for x in rng.choice(centres)]) for i in range(n)]
    q, a = rows(150), rows(300)
    kind = "stratum string, v array<double>"
    sides = spark.createDataFrame(q, f"query_id long, {kind}"), spark.createDataFrame(a, f"neighbor_id int, {kind}")
    got = sorted((r.query_id, r["rank"], r.neighbor_id) for r in context.knn_map(*sides, 5, 16).collect())
    want = []
    for i, s, v in q:
        near = sorted((math.dist(v, w), j) for j, t, w in a if s == t)[:5]
        want += [(i, r, j) for r, (_, j) in enumerate(near, 1)]
    assert got == sorted(want)
    assert all(r.share_of_rows > 0.5 for r in context.knn_pruning(*sides, 5, 16).collect())


def test_x15_only_touched_gates_equal_a_full_rebuild(spark):
    rng = random.Random(7)
    cells, entities, peaks = range(12), ["e1", "e2"], [1, 2]
    keys = spark.createDataFrame([("r1", "RNA", "e1", None), ("r2", "RNA", "e2", None), ("o1", "OPEN", None, 1), ("o2", "OPEN", None, 2), ("d11", "DNA", "e1", 1), ("d12", "DNA", "e1", 2), ("d21", "DNA", "e2", 1)], "gate_key_id string, channel string, entity_id string, peak_id long")
    act = spark.createDataFrame([(c, e, rng.random(), c != 3) for c in cells for e in entities], "cell_id int, entity_id string, activity double, observed boolean")
    acc = spark.createDataFrame([(c, p, rng.random()) for c in cells for p in peaks if (c, p) != (5, 2)], "cell_id int, peak_id long, access double")
    mass = spark.createDataFrame([(c, 5) for c in cells], "cell_id int, mass long")
    split = spark.createDataFrame([(c, "train") for c in cells], "cell_id int, split string")
    fit = context.fit_gates(context.raw_gates(keys, act, acc), mass, split, least_n=1)
    old = context.apply_gates(context.raw_gates(keys, act, acc), fit)
    for cell, kind, source, value in [(2, "activity", "e1", 0.4), (3, "activity", "e1", 0.4), (5, "activity", "e1", 9.0), (4, "access", "1", 0.2), (4, "access", "2", 50.0)]:
        change = spark.createDataFrame([("c", cell, kind, source, value)], "change_id string, cell_id int, kind string, source_id string, value double")
        got = context.perturbed_gates(change, keys, act, acc, fit)
        if kind == "activity":
            raw = context.raw_gates(keys, context.overridden(act, change.selectExpr("cell_id", "source_id AS entity_id", "value AS activity"), ["cell_id", "entity_id"], "activity"), acc)
        else:
            raw = context.raw_gates(keys, act, context.overridden(acc, change.selectExpr("cell_id", "bigint(source_id) AS peak_id", "value AS access"), ["cell_id", "peak_id"], "access"))
        full = {(r.gate_key_id, r.cell_id): r.gate for r in context.apply_gates(raw, fit).collect()}
        merged = {(r.gate_key_id, r.cell_id): r.gate for r in context.merged_gates(old, got).collect()}
        assert merged.keys() == full.keys() and all(math.isclose(merged[k], full[k], abs_tol=1e-12) for k in full)
        support = {r.support for r in got.collect()}
        assert support == {{3: "missing_context", 5: "model_extrapolation", 4: "model_extrapolation" if value > 1 else "supported"}.get(cell, "supported")}
    for bad in [("c", 2, "activity", "e9", 1.0), ("c", 99, "activity", "e1", 1.0), ("c", 2, "activity", "e1", -1.0), ("c", 2, "access", "7", 1.0)]:
        change = spark.createDataFrame([bad], "change_id string, cell_id int, kind string, source_id string, value double")
        with pytest.raises(Exception, match="source"):
            context.perturbed_gates(change, keys, act, acc, fit).collect()


def test_f7_runs_equal_all_pairs(spark):
    rng = random.Random(5)
    paths = [(rng.choice("gh"), i, rng.choice("xyz"), [rng.choice(["e", "f", "ef", "", None]) for _ in range(rng.randint(1, 7))]) for i in range(60)]
    d = spark.createDataFrame(paths, "gene_id string, path_id int, alternative string, edges array<string>")

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for flip in (True, False):
        turn = (lambda e: e[::-1]) if flip else (lambda e: e)
        want = {p: max([0, *(common(turn(e), turn(f)) for h, _, o, f in paths if h == g and o != x)]) for g, p, x, e in paths}
        assert {r.path_id: r.shared for r in identify.shared_context(d, flip).collect()} == want


def test_x10_reasons_of_every_threshold(spark):
    raw = [("few", 1, 0.0), ("few", 2, 1.0), *[("flat", c, 2.0) for c in range(1, 7)], *[("good", c, float(c)) for c in range(1, 7)], ("unseen", 1, None), ("heavy", 6, 1.0), ("heavy", 1, 2.0), ("heavy", 2, 3.0)]
    raw = spark.createDataFrame([(g, c, x, x is not None) for g, c, x in raw], "gate_key_id string, cell_id int, raw double, observed boolean")
    mass = spark.createDataFrame([*((c, 2) for c in range(1, 6)), (6, 1000)], "cell_id int, mass long")
    split = spark.createDataFrame([(c, "train") for c in range(1, 7)], "cell_id int, split string")
    out = {r.gate_key_id: (r.reasons, r.n_valid, r.informative) for r in context.fit_gates(raw, mass, split, least_n=1.005, least_sd=0.0, least_cells=3, least_mass=10).collect()}
    assert out["few"] == ("few_cells,few_molecules", 2, 4.0) and out["good"] == ("", 6, 1010.0) and out["flat"] == ("no_variance", 6, 1010.0)
    assert out["unseen"] == ("never_observed,few_cells,few_effective_cells,few_molecules,no_variance", 0, 0.0) and out["heavy"][0] == ""
