"""Exact ranks and row spaces against rational elimination."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import exact
from tallgrass.operators import identify


def rational_rank(rows):
    m, rank = [[Fraction(int(x)) for x in r] for r in rows], 0
    for c in range(len(m[0]) if m else 0):
        pivot = next((r for r in range(rank, len(m)) if m[r][c]), None)
        if pivot is None:
            continue
        m[rank], m[pivot] = m[pivot], m[rank]
        for r in range(rank + 1, len(m)):
            if m[r][c]:
                f = m[r][c] / m[rank][c]
                m[r] = [a - f * b for a, b in zip(m[r], m[rank], strict=True)]
        rank += 1
    return rank


def test_ranks_and_row_spaces_equal_rational_elimination():
    rng = np.random.default_rng(1)
    matrices = [rng.integers(0, 2, (rng.integers(1, 9), rng.integers(1, 12))) for _ in range(150)]
    matrices += [np.array([[1, 1, 0], [0, 1, 1], [1, 0, 1]]), np.zeros((2, 3), int), rng.integers(0, 2, (30, 26))]
    want = [rational_rank(m.tolist()) for m in matrices]
    assert exact.ranks(matrices) == want and want[150] == 3  # over two elements that one has rank 2
    for m, rank in zip(matrices[:80], want, strict=False):
        vectors = rng.integers(0, 2, (6, m.shape[1]))
        space = exact.RowSpace(m)
        assert space.rank == rank and space.holds(vectors).tolist() == [rational_rank([*m.tolist(), v.tolist()]) == rank for v in vectors]


def test_primes():
    first = [exact.prime(k) for k in range(3)]
    assert first[0] == 2**31 - 1 and len(set(first)) == 3 and all(p > 2**30 and all(p % d for d in range(2, 1000)) for p in first)
    assert exact.primes_for(5) <= 2 and exact.primes_for(80) > 5


def genes(seed, n=12):
    """Random genes: paths, training patterns, and held-out rows."""
    rng = random.Random(seed)
    paths, patterns, held = [], [], []
    for g in range(n):
        ps = [f"p{i}" for i in range(rng.randint(2, 6))]
        paths += [(f"g{g}", p) for p in ps]
        seen = {tuple(sorted(rng.sample(ps, rng.randint(1, len(ps) - 1)))) for _ in range(rng.randint(1, 5))}
        patterns += [(f"g{g}", ";".join(s), list(s), rng.randint(1, 5)) for s in seen]
        for c in range(4):
            for _ in range(rng.randint(1, 4)):
                s = sorted(rng.sample(ps, rng.randint(1, len(ps))))
                held.append(("val" if c < 2 else "test", f"c{c}", f"g{g}", s, len(ps), float(rng.randint(0, 4))))
    # a cycle: no row of ones and no pattern tells its four groups apart
    paths += [("ring", p) for p in "abcd"]
    patterns += [("ring", f"{x};{y}", [x, y], 3) for x, y in ("ab", "bc", "cd", "ad")]
    held += [("val", "c0", "ring", ["a", "b"], 4, 2.0), ("val", "c1", "ring", ["b"], 4, 2.0)]
    return paths, patterns, held


def frames(spark, seed):
    paths, patterns, held = genes(seed)
    return (
        spark.createDataFrame(paths, "gene_id string, path_id string"),
        spark.createDataFrame(patterns, "gene_id string, paths_key string, paths array<string>, mass long"),
        spark.createDataFrame(held, "split string, cell_id string, gene_id string, paths array<string>, n_legal int, mass double"),
    )


def grouped(paths, patterns):
    """gene -> sets of paths that lie in the same patterns."""
    out = {}
    for g in {g for g, _ in paths}:
        by = {}
        for p in [p for h, p in paths if h == g]:
            by.setdefault(frozenset(k for h, k, ps, _ in patterns if h == g and p in ps), set()).add(p)
        out[g] = list(by.values())
    return out


def vector(groups, chosen):
    return [int(bool(x & chosen)) for x in groups]


def test_f5_cells_equal_the_definition(spark):
    paths, patterns, held = genes(4)
    p, t, ec = frames(spark, 4)
    groups = identify.observational_groups(t, p)
    index = identify.augmented_rank(t, groups)
    separable = {r.gene_id: r.separable for r in index.collect()}
    got = {(r.split, r.cell_id, r.gene_id): r for r in identify.cell_support(ec, groups, index).collect()}
    sets = grouped(paths, patterns)
    want = {}
    for split, cell, gene, ps, n, mass in held:
        want.setdefault((split, cell, gene), []).append((set(ps), n, mass))
    assert got.keys() == want.keys() and len(want) > 40
    tiers = set()
    for key, rows in want.items():
        g = sets[key[2]]
        inside = [(s, m) for s, n, m in rows if m > 0 and len(s) < n]
        valid = [(s, m) for s, m in inside if all(not x & s or x <= s for x in g)]
        rank = rational_rank([*{tuple(vector(g, s)) for s, _ in valid}, [1] * len(g)])
        own = [sum(m for s, m in valid if s <= x) for x in g]
        tier = "unidentifiable" if not separable[key[2]] else "direct" if rank == len(g) and all(o >= 1 for o in own) else "cohort"
        r = got[key]
        assert (r.groups, r.rank, r.tier, r.novel_split, r.exclusive_mass) == (len(g), rank, tier, len(valid) < len(inside), sum(own)), key
        tiers.add(tier)
    assert tiers == {"direct", "cohort", "unidentifiable"}


def test_f5_refuses_training_rows_and_unknown_genes(spark):
    p, t, ec = frames(spark, 5)
    groups = identify.observational_groups(t, p)
    index = identify.augmented_rank(t, groups)
    for bad, message in ((ec.withColumn("split", F.lit("train")), "training rows"), (ec.withColumn("gene_id", F.lit("nowhere")), "without a training index"), (ec.withColumn("mass", F.lit(-1.0)), "finite and 0")):
        with pytest.raises(Exception, match=message):
            identify.cell_support(bad, groups, index).collect()


def test_f9_contrasts_equal_the_definition(spark):
    paths, patterns, _ = genes(6)
    p, t, _ = frames(spark, 6)
    rng = random.Random(2)
    member = [(f"c{g}", rng.choice("ABC"), g, q, rng.choice(["x", "y", None]), rng.random() < 0.8) for g, q in paths]
    m = spark.createDataFrame(member, "choice_id string, alternative_id string, gene_id string, path_id string, context string, eligible boolean")
    alternatives = m.groupBy("gene_id", "choice_id", "alternative_id").agg(F.collect_set("path_id").alias("paths"))
    groups = identify.observational_groups(t, p)
    got = {(r.choice_id, r.context, r.a, r.b): r for r in identify.estimable_contrasts(identify.subset_contrasts(alternatives, m), t, groups, 2).collect()}
    sets = grouped(paths, patterns)
    want = {}
    for g in sets:
        rows = [r for r in member if r[2] == g]
        for context in (None, "x", "y"):
            of = {}
            for _, a, _, q, c, ok in rows:
                if context is None or (c == context and ok):
                    of.setdefault(a, set()).add(q)
            for a in of:
                for b in of:
                    if a < b:
                        want[(f"c{g}", context, a, b)] = (g, of[a], of[b])
    assert got.keys() == want.keys() and any(k[1] for k in want)
    seen = set()
    for key, (g, left, right) in want.items():
        operator = [[1] * len(sets[g]), *(vector(sets[g], set(ps)) for h, _, ps, _ in patterns if h == g)]
        status = []
        for side in (left, right):
            whole = all(not x & side or x <= side for x in sets[g])
            inside = whole and rational_rank([*operator, vector(sets[g], side)]) == rational_rank(operator)
            status.append((inside, sum(n for h, _, ps, n in patterns if h == g and set(ps) <= side)))
        r = got[key]
        assert (r.estimable_a, r.mass_a, r.estimable_b, r.mass_b) == (*status[0], *status[1]), key
        assert r.separable == (status[0][0] and status[1][0]) and r.reportable == (r.separable and min(status[0][1], status[1][1]) >= 2)
        seen.add((r.separable, r.reportable))
    assert len(seen) == 3
