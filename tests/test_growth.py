"""Steps whose memory, shuffles or times must not grow faster than their input."""

import math

from pyspark.sql import functions as F

from tallgrass.operators import graph, metrics, reports
from tallgrass.plans import bindings, catalog
from tallgrass.streaming import components as linked


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_permutations_are_not_broadcast(spark):
    """An exploded table is estimated at its size before, so that Spark would broadcast b rows a cell."""
    cells = spark.range(60).selectExpr("id AS cell_id", "id % 2 AS stratum")
    out = reports.permutation_assignments(cells, 5)
    assert "Broadcast" not in plan_of(out)
    rows = out.collect()
    assert len(rows) == 300
    for b in range(5):
        for s in range(2):
            mine = [r for r in rows if r.permutation == b and r.stratum == s]
            assert sorted(r.target for r in mine) == sorted(r.source for r in mine) == list(range(s, 60, 2))


def test_permuted_values_are_not_broadcast(spark):
    """The values of all cells grow with the cells (R2)."""
    cells = spark.range(60).selectExpr("id AS cell_id", "id % 2 AS stratum")
    out = reports.apply_permutation(cells.selectExpr("cell_id", "cell_id * 10 AS x"), reports.permutation_assignments(cells, 3))
    assert "Broadcast" not in plan_of(out)
    assert sorted(r.x for r in out.where("permutation = 1").collect()) == [10 * i for i in range(60)]


def test_graphs_are_worked_out_once(spark):
    """Nodes, edges and steps come from one written table of paths; the steps bring their own places."""
    rows = [(1, 1, "+", [(0, 100), (150, 200)]), (1, 2, "+", [(0, 30), (60, 200)]), (2, 3, "-", [(0, 120), (90, 200)]), (2, 4, "-", [(10, 300)])]
    paths = spark.createDataFrame(rows, "gene_id long, path_id long, strand string, exons array<struct<s:long,e:long>>")
    nodes, edges, steps = graph.compile_graph(paths)
    assert all("Join" not in plan_of(d) for d in (nodes, edges, steps, graph.path_spans(steps, edges)))
    got = {(r.gene_id, r.edge_id) for r in edges.where("edge_type = 'RETAINED_INTRON'").collect()}
    assert got == {(1, "1:donor:30>1:acceptor:60>RETAINED_INTRON"), (1, "1:donor:100>1:acceptor:150>RETAINED_INTRON")}
    # ends the wrong way round, of overlapping exons, still mark the exon of another path
    assert {r.pos for r in nodes.where("gene_id = 2").collect()} == {0, 10, 90, 120, 200, 300}


def test_softmax_of_sets_needs_no_sort(spark):
    """Logits of a cell and gene stay in one row: no window sorts them, and no join moves them."""
    rows = [(c, "g", [(f"p{i}", float((7 * c + 3 * i) % 5)) for i in range(4)]) for c in range(3)]
    sets = spark.createDataFrame(rows, "cell_id long, gene_id string, logits array<struct<path_id:string,logit:double>>")
    flat = sets.selectExpr("cell_id", "gene_id", "inline(logits)")
    counts = flat.selectExpr("cell_id", "gene_id", "path_id", "cell_id + 1 AS n").where("path_id <> 'p1'")
    ec = spark.createDataFrame([(0, "g", ["p0", "p2"], 3, 4), (1, "g", ["p3"], 1, 4)], "cell_id long, gene_id string, paths array<string>, mass long, n_legal int")
    groups = flat.selectExpr("gene_id", "path_id", "right(path_id, 1) % 2 AS group_id").distinct()
    for run in (metrics.log_softmax, lambda x: metrics.agreement(x, counts), lambda x: metrics.compatible_nll(x, ec), lambda x: metrics.group_probability(x, groups)):
        out, want = run(sets), run(flat)
        assert "Window" not in plan_of(out) and "SortMergeJoin" not in plan_of(out)
        near = lambda d: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect())
        assert near(out) == near(want) and near(out)


def test_components_write_no_more_than_nodes_of_chunks(spark, monkeypatch):
    """Each task joins its own links first, so that dense links leave few rows to shuffle and write."""
    written, cut = [], linked.cut
    monkeypatch.setattr(linked, "cut", lambda d, *kind: (out := cut(d, *kind), written.append(out.count()))[0])
    ids = [(c, i) for c in range(3) for i in range(40)]
    links = [(f"n{c}-{i}", f"n{c}-{j}") for c, i in ids for j in range(40) if i != j] + [(None, "x"), ("x", "x")]
    got = linked.components(spark.createDataFrame(links, "a string, b string").repartition(2)).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((f"n{c}-{i}", f"n{c}-0") for c, i in ids)
    assert sum(written) <= 3 * 2 * len(ids) < len(links) / 2


def test_components_of_chains_over_chunks(spark, monkeypatch):
    """A chain that no chunk holds whole has one root, its least node."""
    monkeypatch.setattr(linked, "CHUNK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        links = spark.range(0, 90, 1, 5).where("id % 30 <> 29").selectExpr("(id * 37) % 90 AS a", "((id + 1) * 37) % 90 AS b")
        got = {r.node: r.root for r in linked.components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in range(3):
        chain = [k * 37 % 90 for k in range(30 * c, 30 * c + 30)]
        assert {got[x] for x in chain} == {min(chain)}
    assert len(got) == 90


def test_group_probabilities_stay_in_their_rows(spark):
    """Sums of groups are worked out within a row: no aggregate or shuffle by cell, gene and group."""
    rows = [(1, "g", [("c", 2.0), ("a", 0.0), ("b", 1.0)]), (2, "g", [("a", 0.0), ("b", 0.0)]), (3, "h", [("a", 1.0)]), (4, "none", [("a", 1.0)])]
    sets = spark.createDataFrame(rows, "cell_id long, gene_id string, logits array<struct<path_id:string,logit:double>>")
    named = [("g", "a", "x"), ("g", "b", "y"), ("g", "c", "x"), ("g", "c", "z"), ("g", None, "y"), ("h", "a", None), ("h", "b", "w")]
    out = metrics.group_probability(sets, spark.createDataFrame(named, "gene_id string, path_id string, group_id string"))
    assert "hashpartitioning(cell_id" not in plan_of(out)
    total = 1 + math.e + math.e**2
    want = {(1, "x"): (1 + math.e**2) / total, (1, "y"): math.e / total, (1, "z"): math.e**2 / total, (2, "x"): 0.5, (2, "y"): 0.5, (3, None): 1.0}
    got = {(r.cell_id, r.group_id): r for r in out.collect()}
    assert got.keys() == want.keys()
    for k, p in want.items():
        assert abs(got[k].p - p) < 1e-12 and abs(got[k].logp - math.log(p)) < 1e-12


def test_exons_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks that join lines to orders and gather exons have a bounded number of rows, whatever the shuffle partitions (G1)."""
    monkeypatch.setattr(bindings, "TASK_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    lines = bindings.bind(spark, sf, "lineitem").count()
    exons = bindings.bind(spark, sf, "exons")
    tasks = exons.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 1500 and sum(r["count"] for r in tasks) == lines
    assert "hashpartitioning(l_orderkey#" in plan_of(exons) and f", {1 + lines // 500})" in plan_of(catalog.QUERIES["g1_introns"](spark, sf))


def test_counts_and_evidence_are_dealt_by_their_number(spark, monkeypatch):
    """The tables of the dataset check are made by tasks of a bounded number of rows, and are those of the SQL (Q10)."""
    monkeypatch.setattr(bindings, "TASK_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    n = 1 + bindings.bind(spark, sf, "lineitem").count() // 500
    assert f", {n})" in plan_of(catalog.QUERIES["q10_validate_dataset"](spark, sf))
    for name in ("counts", "ec"):
        own, plain = bindings.bind(spark, sf, f"dealt_{name}"), bindings.bind(spark, sf, name)
        assert max(r["count"] for r in own.groupBy(F.spark_partition_id()).count().collect()) < 2000
        assert sorted(map(repr, own.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_one_pass_serves_logits_counts_and_evidence(spark, monkeypatch):
    """Lines are read and moved once, whatever the tables' sizes, by tasks of a bounded number of rows."""
    monkeypatch.setattr(bindings, "TASK_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    n = 1 + bindings.bind(spark, sf, "lineitem").count() // 500
    for name in ("m3_nll_summary", "m13_monitor_record"):
        plan = plan_of(catalog.QUERIES[name](spark, sf))
        assert plan.count("FileScan parquet [l_") == 1 and plan.count(f", {n})") == 5  # two sides of two joins, cell and gene
    for name in ("m2_compatible_nll", "m3_nll_summary", "m8_count_kl", "m9_agreement", "m10_agreement_summary", "m13_monitor_record"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sha2(") == 1  # no filter works out the logits again
    units = bindings.bind(spark, sf, "dealt_units")
    assert max(r["count"] for r in units.groupBy(F.spark_partition_id()).count().collect()) < 2000
    flat = {
        "logits": units.selectExpr("cell_id", "gene_id", "inline(logits)"),
        "counts": units.selectExpr("cell_id", "gene_id", "inline(counts)"),
        "ec_partial": units.selectExpr("cell_id", "gene_id", "inline(ec)").withColumn("paths_key", F.array_join("paths", ";")),
    }
    for name, own in flat.items():
        plain = bindings.bind(spark, sf, name)
        assert sorted(map(repr, own.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_monitor_record_of_tables_and_units(spark):
    """Cells with evidence alone, counts alone, neither, a repeated row and a set without logits, by hand."""
    logits = spark.createDataFrame([(c, "g", p, 0.0) for c in range(5) for p in "abcd"], "cell_id long, gene_id string, path_id string, logit double")
    rows = [(0, "g", ["a"], 2, 4), (0, "g", ["a"], 2, 4), (1, "g", ["a", "b"], 4, 4), (1, "g", ["x"], 9, 4), (1, "g", ["a", "b", "c", "d"], 7, 4), (9, "g", ["a"], 1, 4)]
    counts = spark.createDataFrame([(1, "g", "a", 1), (1, "g", "b", 1), (2, "g", "a", 3), (2, "g", "c", 1), (3, "g", "a", 5)], "cell_id long, gene_id string, path_id string, n long")
    kl = (2 * math.log(2) + 4 * (0.75 * math.log(3))) / 6
    for kind in ("long", "double"):
        ec = spark.createDataFrame([(*r[:3], float(r[3]) if kind == "double" else r[3], r[4]) for r in rows], f"cell_id long, gene_id string, paths array<string>, mass {kind}, n_legal int")
        units = metrics.with_own(logits, "left", ec=ec, counts=counts)
        for got in (metrics.monitor_record(logits, ec, counts).first(), metrics.monitor_record(units).first()):
            assert abs(got.nll - (4 * math.log(4) + 4 * math.log(2)) / 8) < 1e-12 and got.nll_mass == 8
            assert abs(got.kl - kl) < 1e-12 and got.kl_cell_genes == 2
    assert metrics.monitor_record(logits, ec.limit(0), counts.limit(0)).first() == (None, None, None, 0)
