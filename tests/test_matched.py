"""Reports and checks that fail closed."""

import math

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import compat, design, graph, matched, metrics, routes
from tallgrass.streaming import components


def readouts(spark, change=None):
    rows = [(s, m, c, "g", "e", 1.0 + c, float(c + (m == "b")), 0.1 * c, "x" if c < 2 else "y") for s in (1, 2, 3) for m in "ab" for c in range(4)]
    rows = change(rows) if change else rows
    return spark.createDataFrame(rows, "seed int, model string, cell_id int, gene_id string, ec_id string, mass double, nll_sum double, calibration double, axis1 string")


def test_r9_compares_matched_records_by_axis(spark):
    got = {(r.seed, r.level): r for r in matched.compare_readouts(readouts(spark), "a", "b", ["axis1"]).collect()}
    r = got[(1, "overall")]
    assert math.isclose(r.nll_a, 0.6) and math.isclose(r.gain, 0.4) and r.rows == 4 and r.mass == 10 and math.isclose(r.calibration_a, 0.15) and math.isclose(r.weighted_calibration_a, 0.2)
    assert math.isclose(got[(2, "x")].gain, 2 / 3) and len(got) == 9
    claim = matched.readout_claim(matched.compare_readouts(readouts(spark), "a", "b", ["axis1"]), 0.3).first()
    assert (claim.seeds, claim.claim) == (3, True)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda r: r + [r[0]], "a record is repeated"),
        (lambda r: r[1:], "records differ between groups"),
        (lambda r: [(*x[:5], 9.0, *x[6:]) if i == 3 else x for i, x in enumerate(r)], "a fixed column differs"),
        (lambda r: [(x[0], "c", *x[2:]) if i == 3 else x for i, x in enumerate(r)], "another model"),
        (lambda r: [(*x[:6], float("nan"), *x[7:]) if i == 3 else x for i, x in enumerate(r)], "a number is not valid"),
        (lambda r: [(*x[:2], None, *x[3:]) if i == 3 else x for i, x in enumerate(r)], "a key is null"),
    ],
)
def test_r9_refuses_what_would_bias(spark, change, message):
    with pytest.raises(Exception, match=message):
        matched.compare_readouts(readouts(spark, change), "a", "b", ["axis1"]).collect()


def test_r8_refuses_selections_outside_and_outcomes(spark):
    eligible = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, split string")
    got = {tuple(r.stratum_values or []): (r.eligible, r.selected) for r in matched.checked_coverage(eligible, eligible.where("k = 1").select("k"), ["k"], [[], ["split"]]).collect()}
    assert got == {(): (3, 1), ("a",): (2, 1), ("b",): (1, 0)}
    with pytest.raises(Exception, match="not eligible"):
        matched.checked_coverage(eligible, spark.createDataFrame([(9,)], "k int"), ["k"], [[]]).collect()
    with pytest.raises(ValueError, match="outcomes"):
        matched.checked_coverage(eligible, eligible.withColumn("Test_NLL_x", F.lit(1)), ["k"], [[]])


def test_r6_needs_the_same_cells_in_every_seed(spark):
    rows = [("r", s, c, st, v + 0.01 * s) for s in (1, 2, 3) for st, v in (("p", 1.0), ("q", 0.2)) for c in range(st == "q" and 10 or 0, st == "q" and 14 or 4)]
    kind = "record string, seed int, cell_id int, state string, value double"
    args = (["record"], [("p", "q"), ("q", "p"), ("p", "none")], 3, 0.001, 0.05, 0.5)
    got = {(r.state_a, r.state_b): r for r in matched.state_contrasts(spark.createDataFrame(rows, kind), *args).collect()}
    assert got["p", "q"].status == "stable" and math.isclose(got["p", "q"].median, 0.8) and got["q", "p"].status == "stable" and got["p", "none"].status == "not_estimable"
    with pytest.raises(Exception, match="records differ"):
        matched.state_contrasts(spark.createDataFrame(rows[1:], kind), *args).collect()


def test_r11_strata_are_once_per_gene(spark):
    e = spark.createDataFrame([("m", 1, "g", "r1", -2.0, 1.0, 0.1, "consistent", "stable", True), ("m", 1, "g", "r2", 4.0, 3.0, 0.3, "mixed", "stable", True), ("m", 2, "h", "r1", 9.0, 9.0, 9.0, "mixed", "dispersed", False)], "model string, cell_id int, gene_id string, record_id string, median double, iqr double, dispersion double, direction string, magnitude string, primary boolean")
    s = spark.createDataFrame([("g", "low"), ("h", "high")], "gene_id string, burden string")
    r = matched.attribution_strata(e, s, ["burden"]).collect()
    assert len(r) == 1 and (r[0].records, r[0].cell_genes, r[0].direction_stable, r[0].magnitude_stable, r[0].median_size, r[0].median_iqr) == (2, 1, 1, 2, 3.0, 2.0)
    for bad, message in ((s.where("gene_id = 'h'"), "no stratum"), (s.unionByName(s), "strata are repeated")):
        with pytest.raises(Exception, match=message):
            matched.attribution_strata(e, bad, ["burden"]).collect()
    with pytest.raises(Exception, match="a record is repeated"):
        matched.attribution_strata(e.unionByName(e), s, ["burden"]).collect()


def test_r13_across_seeds_and_empty_cells(spark):
    rows = [("m", s, c, g, g == "g", 2.0, float(s + c)) for s in (1, 2, 3) for c in range(2) for g in ("g", "h")]
    kind = "model string, seed int, cell_id int, gene_id string, high boolean, total double, x double"
    bins = spark.createDataFrame([("g", "paths", "few", 0), ("h", "paths", "many", 1)], "gene_id string, stratifier string, bin string, bin_order int")
    per = matched.seed_sensitivity(spark.createDataFrame(rows, kind), bins, ["x"])
    got = {(r.bin, r.high, r.aggregation): r for r in matched.across_seeds(per).collect()}
    assert len(got) == 8
    few = got["few", True, "macro"]
    assert (few.status, few.mean, few.sd, few.range, few.rows, few.mass) == ("estimable", 2.5, 1.0, 2.0, 2, 4.0)
    empty = got["few", False, "macro"]
    assert (empty.status, empty.mean, empty.rows) == ("not_estimable", None, 0)
    with pytest.raises(Exception, match="has no bin"):
        matched.seed_sensitivity(spark.createDataFrame(rows, kind), bins.where("gene_id = 'g'"), ["x"]).collect()
    with pytest.raises(Exception, match="two bins"):
        matched.seed_sensitivity(spark.createDataFrame(rows, kind), bins.unionByName(bins), ["x"]).collect()
    with pytest.raises(Exception, match="denominators differ"):
        matched.across_seeds(per.withColumn("rows", F.col("rows") + F.when(F.col("seed") == 1, 1).otherwise(0))).collect()


def test_m17_masks_what_is_not_estimable(spark):
    kind = "cell_id int, gene_id string, path_id string, logit double"
    full = spark.createDataFrame([(c, "g", p, x) for c in (1, 2) for p, x in (("a", 0.0), ("b", 1.0), ("c", -800.0))], kind)
    changed = spark.createDataFrame([(c, "g", p, x) for c in (1, 2) for p, x in (("a", 1.0), ("b", 1.0), ("c", -800.0))], kind)
    status = spark.createDataFrame([(1, "g", True), (2, "g", False)], "cell_id int, gene_id string, estimable boolean")
    groups = spark.createDataFrame([("g", "a", "x"), ("g", "b", "x"), ("g", "c", "y")], "gene_id string, path_id string, group_id string")
    got = {(r.cell_id, r.group_id): r for r in metrics.group_effects(full, changed, groups, status).collect()}
    lse = math.log(1 + math.e), math.log(2 * math.e)
    assert math.isclose(got[1, "y"].delta_log, -lse[0] + lse[1]) and abs(got[1, "x"].delta) < 1e-12 and got[2, "x"].full is None
    c = spark.createDataFrame([("q", "g", ["a"], ["b"], True), ("r", "g", ["a"], ["b", "c"], False)], "contrast_id string, gene_id string, numerator array<string>, denominator array<string>, reportable boolean")
    out = {(r.cell_id, r.contrast_id): r for r in metrics.contrast_effects(full, changed, c, status).collect()}
    assert math.isclose(out[1, "q"].full, -1.0) and math.isclose(out[1, "q"].delta, -1.0) and out[2, "q"].delta is None and out[1, "r"].delta is None
    for bad, message in ((changed.where("path_id <> 'c'"), "lacks one"), (changed.where("cell_id = 1"), "lacks one")):
        with pytest.raises(Exception, match=message):
            metrics.group_effects(full, bad, groups, status).collect()
    with pytest.raises(Exception, match="repeated"):
        metrics.contrast_effects(full, changed, c.unionByName(c), status).collect()
    with pytest.raises(Exception, match="no status"):
        metrics.group_effects(full, changed, groups, status.where("cell_id = 1")).collect()


def test_c7_conflicts_are_errors(spark):
    a = spark.createDataFrame([("t1", "d", "l", 1, "chr1", 10)], "tx_id string, donor_id string, library_id string, barcode int, chrom string, start long")
    cells = spark.createDataFrame([("d", "l", 1, 7, "train")], "donor_id string, library_id string, barcode int, cell_id int, split string")
    genes = lambda chrom, end: spark.createDataFrame([("t1", "g", chrom, end)], "tx_id string, gene_id string, gene_chrom string, gene_end long")
    assert compat.assign_gene_cell(a, genes("chr1", 11), cells)[0].count() == 1
    for bad, message in ((genes("chr2", 11), "chromosome conflict"), (genes("chr1", 10), "behind the gene's end")):
        with pytest.raises(Exception, match=message):
            compat.assign_gene_cell(a, bad, cells)[0].collect()


def test_c11_evidence_scope_and_censoring(spark):
    kind = "molecule_id string, intron_id int, is_primary boolean, is_chimeric boolean, mapq int, left_exon int, left_intron int, right_intron int, right_exon int, excising boolean, other_junctions int, unspliced_introns int, mature boolean"
    rows = [
        ("both", 1, True, False, 60, 9, 9, 9, 9, False, 0, 1, False), ("mature", 1, True, False, 60, 9, 9, 9, 9, False, 1, 2, True), ("spliced", 1, True, False, 60, 9, 9, 9, 9, False, 1, 1, False),
        ("cut", 1, True, False, 60, 9, 9, 9, 9, True, 0, 1, False), ("one", 1, True, False, 60, 9, 9, 0, 0, False, 0, 1, False), ("in", 1, True, False, 60, 0, 5, 5, 0, False, 0, 1, False),
        ("bad", 1, True, False, 3, 9, 9, 9, 9, False, 0, 1, False), ("none", 1, True, False, 60, 9, 0, 0, 0, False, 0, 1, False),
    ]
    got = {r.molecule_id: (r.evidence, r.supported, r.censored, r.scope) for r in compat.intron_evidence(spark.createDataFrame(rows, kind), 20, 4, 4).collect()}
    assert got == {
        "both": ("bilateral", True, False, "mature_or_nascent"), "mature": ("bilateral", True, False, "mature_by_protocol"), "spliced": ("bilateral", True, False, "processed_context"),
        "cut": ("excising_junction", False, True, "not_retained"), "one": ("single_boundary", False, True, "not_retained"), "in": ("intron_only", False, True, "not_retained"),
        "bad": ("qc_failure", False, False, "not_retained"), "none": ("no_boundary", False, True, "not_retained"),
    }
    with pytest.raises(Exception, match="an intron twice"):
        compat.intron_evidence(spark.createDataFrame(rows + rows[:1], kind), 20, 4, 4).collect()


def test_g4_every_violation(spark):
    nodes = spark.createDataFrame([("g", n, t, p) for n, t, p in (("T", "TSS", 0), ("D", "donor", 10), ("A", "acceptor", 20), ("E", "donor", 20), ("P", "PAS", 30))], "gene_id string, node_id string, node_type string, pos long")
    edges = spark.createDataFrame(
        [("g", "1", "EXON_CONTINUATION", "T", "D", 10), ("g", "2", "SPLICE", "D", "A", 10), ("g", "3", "EXON_CONTINUATION", "A", "E", 0), ("g", "4", "EXON_CONTINUATION", "E", "P", 10), ("g", "5", "SPLICE", "A", "D", 10), ("g", "6", "SPLICE", "E", "A", 0)],
        "gene_id string, edge_id string, edge_type string, src string, dst string, span long",
    )
    of = {"1": "TD", "2": "DA", "3": "AE", "4": "EP", "5": "AD", "6": "EA", "9": "PP"}
    paths = {"good": "1234", "back": "125", "zero": "1236", "unknown": "9", "short": "1234"}
    steps = spark.createDataFrame([("g", p, i, e, of[e][0], of[e][1]) for p, es in paths.items() for i, e in enumerate(es)], "gene_id string, path_id string, edge_order int, edge_id string, src string, dst string")
    declared = spark.createDataFrame([("g", p, "+", 5 if p == "short" else len(es), "T", "P") for p, es in [*paths.items(), ("empty", "")]], "gene_id string, path_id string, strand string, n_edges int, start string, end string")
    got = {}
    for r in graph.validate_graph(nodes, edges, declared, steps).collect():
        got.setdefault(r.path_id, set()).add(r.violation)
    assert got == {"back": {"wrong_end", "against_strand"}, "zero": {"wrong_end", "bad_coincidence"}, "unknown": {"unknown_edge", "wrong_start", "bad_coincidence"}, "short": {"n_edges_differ"}, "empty": {"no_edges"}}
    moved = steps.withColumn("src", F.when((F.col("path_id") == "good") & (F.col("edge_id") == "3"), "D").otherwise(F.col("src")))
    assert {r.violation for r in graph.validate_graph(nodes, edges, declared, moved).where("path_id = 'good'").collect()} == {"end_points_differ", "discontinuous"}


def test_g8_edge_and_path_features(spark):
    e = spark.createDataFrame([("g", "a", "SPLICE", 0, 10, 0), ("g", "b", "EXON", 10, 30, 20)], "gene_id string, edge_id string, edge_type string, lo long, hi long, length_bp long")
    got = {r.edge_id: (r.is_splice, r.is_exon, r.log_span, r.log_length) for r in graph.edge_features(e, ["SPLICE", "EXON"]).collect()}
    assert got == {"a": (1, 0, math.log1p(10), 0.0), "b": (0, 1, math.log1p(20), math.log1p(20))}
    with pytest.raises(Exception, match="unknown edge type"):
        graph.edge_features(e, ["SPLICE"]).collect()
    steps = spark.createDataFrame([("g", "p", 0, "a"), ("g", "p", 1, "b")], "gene_id string, path_id string, edge_order int, edge_id string")
    r = graph.path_spans(steps, e).first()
    assert (r.log_edges, r.log_span, r.log_length) == (math.log1p(2), math.log1p(30), math.log1p(20))


def test_n2_needs_one_event_per_route(spark):
    events = spark.createDataFrame([(1, "f"), (2, None)], "event_id int, factor string")
    routes = spark.createDataFrame([("r", 1, 5), ("s", 2, None), ("t", 1, -50)], "route_id string, event_id int, distance int")
    got = {r.route_id: (r.factor, r.bin) for r in design.binned_context(events, routes, [0, 10, 100]).collect()}
    assert got == {"r": ("f", "[0,10)"), "s": ("OPEN_ONLY", "NA"), "t": ("f", "[10,100)")}
    for bad, message in ((events.where("event_id = 1"), "no event"), (events.unionByName(events), "several events")):
        with pytest.raises(Exception, match=message):
            design.binned_context(bad, routes, [0, 10, 100]).collect()


def test_t9_coverage_and_sets(spark):
    r = spark.createDataFrame([("r1", 1, "k1"), ("r2", 1, "k2"), ("r3", 2, "k3")], "route_id string, event_id int, gate_key_id string")
    g = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 9), ("c", 9)], "group_id string, event_id int")
    assert {x.group_id: (x.members, x.routed, x.routes, x.coverage) for x in routes.selector_coverage(r, g).collect()} == {"a": (2, 2, 3, "full"), "b": (2, 1, 1, "partial"), "c": (1, 0, 0, "none")}
    s = spark.createDataFrame([("s", "k1"), ("s", "k3"), ("t", "k2")], "set_id string, gate_key_id string")
    assert sorted(x.route_id for x in routes.routes_of_set(r, s, "s").collect()) == ["r1", "r3"]


def test_x14_edges_of_sets(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y"), ("z", "z")], "gate_a string, gate_b string")
    sets = {r.members: r.set_id for r in components.correlated_sets(p).collect()}
    got = sorted((r.set_id, r.gate_a, r.gate_b) for r in components.set_edges(p).collect())
    assert got == sorted([(sets["a,b,c"], "a", "b"), (sets["a,b,c"], "b", "c"), (sets["x,y"], "x", "y")])
