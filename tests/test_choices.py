"""Internal choices (F8) against a plain rule, and what moves for them."""

import random
from collections import defaultdict

import __spark_entry__ as entry
from tallgrass.operators import identify

STEP = "gene_id string, path_id string, edge_order int, edge_id string, src string, dst string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def choices_of(rows):
    """Rows of one gene: (choice, number, edges, paths)."""
    walks = defaultdict(list)
    for _, path, i, edge, src, dst in rows:
        walks[path].append((i, edge, src, dst))
    out, into = defaultdict(set), defaultdict(set)
    for _, _, _, edge, src, dst in rows:
        out[src].add((edge, src, dst))
        into[dst].add((edge, src, dst))
    at = {p: [(e, s, d) for _, e, s, d in sorted(w)] for p, w in walks.items() if p is not None}
    found = {}
    for entry_node in {s for w in at.values() for _, s, _ in w}:
        mine = [(p, i) for p, w in at.items() for i, x in enumerate(w) if x[1] == entry_node]
        if len({at[p][i][0] for p, i in mine}) < 2:
            continue
        ahead = [{d: j for j, (_, _, d) in enumerate(at[p]) if j >= i} for p, i in mine]
        common = set.intersection(*map(set, ahead))
        if not common:
            continue
        far = lambda x, ahead=ahead, mine=mine: [a[x] - i + 1 for a, (_, i) in zip(ahead, mine, strict=True)]
        leave = min(common, key=lambda x: (max(far(x)), sum(far(x)), x))
        alts, inner = defaultdict(set), defaultdict(set)
        for a, (p, i) in zip(ahead, mine, strict=True):
            walk = at[p][i : a[leave] + 1]
            alts[tuple(e for e, _, _ in walk)].add(p)
            for _, _, d in walk[:-1]:
                inner[d].add(tuple(e for e, _, _ in walk))
        if len(alts) >= 2 and all(len(s) == 1 and len(out[d]) == 1 and len(into[d]) == 1 for d, s in inner.items()):
            found[entry_node, leave] = alts
    uses = defaultdict(set)
    for k, alts in found.items():
        for e in (e for a in alts for e in a):
            uses[e].add(k)
    clash = {k for ks in uses.values() if len(ks) > 1 for k in ks}
    return {(f"{a}->{b}", n, edges, tuple(sorted(alts[edges]))) for (a, b), alts in found.items() if (a, b) not in clash for n, edges in enumerate(sorted(alts, key="\0".join))}


def graphs(seed, genes):
    """Paths that skip some of a gene's nodes, in a few kinds of edges; a part of a path without a name counts for degrees only."""
    rng, rows = random.Random(seed), []
    for g in range(genes):
        nodes = [f"n{i:02d}" for i in range(rng.randrange(3, 12))]
        for p in range(rng.randrange(1, 6)):
            walk = [x for i, x in enumerate(nodes) if i in (0, len(nodes) - 1) or rng.random() < rng.choice([0.4, 0.9])]
            name = None if rng.random() < 0.03 else f"p{p}"
            rows += [(f"g{g}", name, i, f"{s}>{d}>{rng.choice('xxxxxy')}", s, d) for i, (s, d) in enumerate(zip(walk, walk[1:], strict=False))]
    return rows


def test_choices_equal_the_plain_rule(spark, monkeypatch):
    rows = [(None, "p", 0, "e", "a", "b"), *graphs(5, 300)]
    want = defaultdict(set)
    for g in {r[0] for r in rows[1:]}:
        want[g] = choices_of([r for r in rows if r[0] == g])
    assert sum(map(len, want.values())) > 200
    for steps, size in ((1 << 16, 1 << 11), (40, 3), (1, 1)):  # genes are whole, wherever a task's rows are cut
        monkeypatch.setattr(identify, "CHUNK_STEPS", steps)
        monkeypatch.setattr(identify, "SLICE", size)
        got = defaultdict(set)
        for r in identify.internal_choices(spark.createDataFrame(rows, STEP)).collect():
            name, number = r.alternative_id.rsplit(":alt:", 1)
            assert name == r.choice_id
            got[r.gene_id].add((name.removeprefix(f"choice:{r.gene_id}:"), int(number), tuple(r.edges), tuple(r.paths)))
        assert got == {g: s for g, s in want.items() if s}


def test_pairs_of_nodes_are_not_moved(spark):
    """Paths are moved once, as numbers; no window or join works on pairs of their nodes or lists of their edges."""
    plan = plan_of(entry.queries()["f8_internal_choices"](spark, "/root/testdata/sf0.001"))
    top, below = plan.split("MapInArrow", 1)
    assert "Exchange" not in top and "Window" not in plan
    assert below.count("Exchange hashpartitioning(gene_id#") >= 1


def test_nothing_to_choose(spark):
    d = spark.createDataFrame([("g", "p", 0, "e", "a", "b"), ("g", "p", 1, "f", "b", "c")], STEP)
    assert identify.internal_choices(d).collect() == [] and identify.internal_choices(d.limit(0)).collect() == []
