"""Both sides of a change of logits are compared within the row of a cell and gene."""

import math
import random
import re

import __spark_entry__ as entry
from tallgrass.operators import metrics

SF = "/root/testdata/sf0.001"
KIND = "cell_id int, gene_id string, path_id string, logit double"
NAMES = ("m17_counterfactual", "m17_group_effects", "m17_contrast_effects", "f14_centred_change")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_path_is_moved(spark):
    """Lines are read and moved once; no join, window or aggregate by path, and no table of paths by cell is shuffled."""
    for name in NAMES:
        plan = plan_of(entry.queries()[name](spark, SF))
        assert plan.count("FileScan parquet [l_") == 1
        dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        assert sum("cell_id" in x for x in dealt) == 1 and not any("cell_id" in x and "path_id" in x for x in dealt)


def soft(x):
    top = max(x.values())
    total = top + math.log(sum(math.exp(v - top) for v in x.values()))
    return {p: v - total for p, v in x.items()}


def test_changes_equal_the_plain_rule(spark):
    """Rows in any order, paths, cells and genes that only one side has."""
    rng = random.Random(2)
    sides = [{(c, g): {p: rng.uniform(-4, 4) for p in "abcdef"[: rng.randrange(1, 7)]} for c in range(30) for g in "xyz" if rng.random() < 0.8} for _ in range(2)]
    tables = []
    for side in sides:
        rows = [(c, g, p, v) for (c, g), x in side.items() for p, v in x.items()] + [(99, "x", None, 1.0)]
        rng.shuffle(rows)
        tables.append(spark.createDataFrame(rows, KIND).repartition(5))
    want = {}
    for k in sides[0].keys() & sides[1].keys():
        a, b = (s[k] for s in sides)
        la, lb, both = soft(a), soft(b), a.keys() & b.keys()
        mean = sum(b[p] - a[p] for p in both) / len(both)
        want |= {(*k, p): (b[p] - a[p], b[p] - a[p] - mean, math.exp(lb[p]) - math.exp(la[p]), lb[p] - la[p]) for p in both}
    got = {(r.cell_id, r.gene_id, r.path_id): (r.delta, r.centred, r.dp, r.dlogp) for r in metrics.counterfactual(*tables).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(math.isclose(x, y, abs_tol=1e-12) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_effects_of_groups_in_one_row(spark):
    """A path in two groups, one named twice, one that no row has, and a group without a name."""
    rng = random.Random(4)
    a, b = ({(c, g): {p: rng.uniform(-4, 4) for p in "abcd"[: 2 + c % 3]} for c in range(9) for g in "xy"} for _ in range(2))
    full, changed = (spark.createDataFrame([(*k, p, v) for k, x in s.items() for p, v in x.items()], KIND) for s in (a, b))
    named = [(g, p, n) for g in "xy" for p, n in (("a", "one"), ("b", "one"), ("b", "two"), ("c", None), ("c", None), ("d", "far"), ("e", "none"), (None, "one"))] + [("z", "a", "one")]
    groups = spark.createDataFrame(named, "gene_id string, path_id string, group_id string")
    status = spark.createDataFrame([(c, g, c % 4 > 0) for c in range(9) for g in "xy"], "cell_id int, gene_id string, estimable boolean")
    got = {(r.cell_id, r.gene_id, r.group_id): r for r in metrics.group_effects(full, changed, groups, status).collect()}
    want = {}
    for k in a:
        for n in {n for _, _, n in named}:
            own = [p for g, p, m in named if g == k[1] and m == n and p in a[k]]
            if own:
                want[*k, n] = [sum(math.exp(soft(s[k])[p]) for p in own) for s in (a, b)]
    assert got.keys() == want.keys()
    for k, (p, q) in want.items():
        r = got[k]
        assert r.estimable == (k[0] % 4 > 0)
        if r.estimable:
            assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in ((r.full, p), (r.changed, q), (r.delta, p - q), (r.delta_log, math.log(p / q))))
        else:
            assert (r.full, r.changed, r.delta, r.delta_log) == (None, None, None, None)
