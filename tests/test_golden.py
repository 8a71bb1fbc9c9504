"""Published example rows, through createDataFrame."""

import math

import pytest

from pyspark.sql import functions as F

from tallgrass.operators import audit, compat, context, identify, intervals, metrics, split, usage
from tallgrass.operators import routes as routes_


def test_x2_activity_sums_members_then_takes_one_log(spark):
    counts = [(c, g, n) for c, row in enumerate([[1, 3, 6], [0, 0, 0], [2, 0, 8]]) for g, n in zip("ABo", row, strict=True)]
    counts = spark.createDataFrame(counts, "cell_id int, gene_id string, n long")
    members = spark.createDataFrame([("A", "g"), ("B", "g")], "gene_id string, entity_id string")
    got = {r.cell_id: (r.activity, r.observed) for r in context.entity_activity(counts, members, counts.select("cell_id")).collect()}
    assert math.isclose(got[0][0], math.log1p(4000)) and got[1] == (None, False) and math.isclose(got[2][0], math.log1p(2000))


def test_x6_far_neighbours_are_invalid_but_counted(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    w = spark.createDataFrame([(1, 10, 5.0, 0.5), (1, 11, 5.0, 0.5)], "query_id int, neighbor_id int, distance double, weight double")
    got = {r.query_id: r for r in context.mapping_audit(q, w, 2, 2.0).collect()}
    assert not got[1].valid and got[1].ess == 2.0 and got[2].reasons == "no_neighbors"


def test_c1_spliced_alignment(spark):
    r = spark.createDataFrame([("50M50N50M", 100)], "c string, s long").select(compat.expand_cigar(F.col("c"), F.col("s")).alias("x")).first().x
    assert [tuple(b) for b in r.blocks] == [(100, 150), (200, 250)]
    assert [tuple(j) for j in r.junctions] == [(150, 200, 50, 50)] and r.deletions == [] and r.clipped == 0


def test_c1_insertions_end_anchors(spark):
    cigars = ["50M2I10M100N5M1I40M", "4H6M9N1I8M2P3=7N2X1D5M2S"]
    d = spark.createDataFrame([(c, 0) for c in cigars], "c string, s long")
    got = [[tuple(j) for j in r.x.junctions] for r in d.select(compat.expand_cigar(F.col("c"), F.col("s")).alias("x")).collect()]
    assert got == [[(60, 160, 10, 5)], [(6, 15, 6, 0), (26, 33, 3, 2)]]


def test_m2_equal_rows_stay_apart(spark):
    logits = spark.createDataFrame([(1, "g", "a", 0.0), (1, "g", "b", 1.0)], "cell_id int, gene_id string, path_id string, logit double")
    ec = spark.createDataFrame([(1, "g", ["a"], 3, 2), (1, "g", ["a"], 3, 2), (1, "g", ["b"], 1, 2)], "cell_id int, gene_id string, paths array<string>, mass long, n_legal int")
    got = metrics.compatible_nll(logits, ec)
    assert sorted((r.mass, round(r.nll, 4)) for r in got.collect()) == [(1, 0.3133), (3, 1.3133), (3, 1.3133)]
    assert metrics.nll_by_gene(got).first().mass == 7
    sets = ec.withColumn("paths_key", F.array_join("paths", ";"))
    assert metrics.compatible_set_metrics(logits, sets).count() == 3
    groups = spark.createDataFrame([("g", "a", "x"), ("g", "b", "y")], "gene_id string, path_id string, group_id string")
    twice = spark.createDataFrame([(1, "g", ["a"], 6, 2), (1, "g", ["b"], 1, 2)], ec.schema).withColumn("paths_key", F.array_join("paths", ";"))
    res = [sorted((r.group_id, round(r.residual, 9)) for r in metrics.score_residuals(logits, e, groups).collect()) for e in (sets, twice)]
    assert res[0] == res[1]


def test_a9_quantiles_of_ties_nulls_and_one_value(spark):
    rows = [("a", x) for x in [5.0, 1.0, 1.0, 2.0, None, 9.0]] + [("b", 7.0), (None, 3.0), (None, 4.0), ("c", None)]
    got = {r.k: (r.linear, r.higher, r.median, r.iqr) for r in audit.quantiles(spark.createDataFrame(rows, "k string, x double").repartition(3), ["k"], "x", 0.9).collect()}
    assert got == {"a": (pytest.approx(7.4), 9.0, 2.0, 4.0), "b": (7.0, 7.0, 7.0, 0.0), None: (pytest.approx(3.9), 4.0, 3.5, 0.5)}


def test_x6_reasons(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 8)], "query_id int")
    one = [(1, 10, 1.0, 0.5), (1, 11, 1.5, 0.5), (2, 10, 1.0, 0.5), (2, 10, 1.0, 0.5), (3, 10, 1.0, 0.5), (3, 11, 9.0, 0.5), (4, 10, 1.0, 0.7), (4, 11, 1.0, 0.7), (5, 10, 1.0, 0.3), (5, 11, 1.0, 0.3), (5, 12, 1.0, 0.4), (6, 10, 1.0, 1.0)]
    w = spark.createDataFrame(one, "query_id int, neighbor_id int, distance double, weight double").withColumns({"paired": F.col("query_id") != 6, "consistency": F.when(F.col("query_id") == 6, "not_estimable").otherwise("pass")})
    got = {r.query_id: (r.reasons, r.valid, r.coverage) for r in context.mapping_audit(q, w, 2, 2.0).collect()}
    assert got == {1: ("", True, 1.0), 2: ("duplicate_neighbor", False, 1.0), 3: ("far", False, 1.0), 4: ("bad_weights", False, 1.0), 5: ("too_many_neighbors", False, 1.5), 6: ("not_paired", False, 0.5), 7: ("no_neighbors", False, 0.0)}


def test_x13_keeps_its_digits_at_large_means(spark):
    rows = [("g1", i, 1e8 + i % 3, True) for i in range(60)] + [("g2", i, 1e8 - i % 3, True) for i in range(60)]
    raw = spark.createDataFrame(rows, "gate_key_id string, cell_id int, raw double, observed boolean")
    keys = spark.createDataFrame([("g1", "g", True), ("g2", "g", True)], "gate_key_id string, gene_id string, active boolean")
    cells = raw.select("cell_id").distinct()
    r = context.gate_collinearity(raw, keys, cells.withColumn("mass", F.lit(1)), cells.withColumn("split", F.lit("train"))).first()
    assert math.isclose(r.r, -1.0, rel_tol=1e-9) and r.status == "perfect"


def test_x13_takes_active_gates_on_training_cells(spark):
    rows = [(g, c, float(c if g == "g1" or c < 5 else -c), True) for g in ("g1", "g2", "off") for c in range(10)]
    raw = spark.createDataFrame(rows, "gate_key_id string, cell_id int, raw double, observed boolean")
    keys = spark.createDataFrame([("g1", "g", True), ("g2", "g", True), ("off", "g", False)], "gate_key_id string, gene_id string, active boolean")
    cells = raw.select("cell_id").distinct()
    split = cells.withColumn("split", F.when(F.col("cell_id") < 5, "train").otherwise("val"))
    got = context.gate_collinearity(raw, keys, cells.withColumn("mass", F.lit(1)), split).collect()
    assert [(r.gate_a, r.gate_b, r.status, r.n_eff) for r in got] == [("g1", "g2", "perfect", 5.0)]


def test_m4_refuses_genes_without_dtu(spark):
    g = spark.createDataFrame([("a", 5.0, 0.1), ("b", 5.0, 0.3), ("c", 5.0, None)], "gene_id string, mass double, dtu double")
    assert metrics.gene_weights(g.where("dtu IS NOT NULL"), 1.0, 0.5).count() == 2
    for bad in (g, g.fillna({"dtu": float("nan")}), g.where("dtu IS NOT NULL").withColumn("mass", F.when(F.col("gene_id") == "a", F.col("mass")))):
        with pytest.raises(Exception, match="no finite dtu"):
            metrics.gene_weights(bad, 1.0, 0.5).collect()


def test_t8_sums_that_differ_in_the_last_digits_stay_apart(spark):
    rows = [("x", "r1", 0.5000001), ("y", "r2", 0.5000003), ("z", "r3", 0.25), ("z", "r4", 0.2500001), ("u", "r5", 0.25), ("u", "r6", 0.2500001), ("v", "r7", 0.25), ("v", "r8", 0.2500001)]
    routes = spark.createDataFrame([("g", "DNA", "k", e, r, "edge", int(e == "v"), w, 1.0) for e, r, w in rows], "gene_id string, modality string, gate_key_id string, event_id string, route_id string, edge_id string, column int, weight double, feature double")
    sig = routes_.injection_signatures(routes)
    groups = {r.event_id: r.group_id for r in sig.collect()}
    assert groups["z"] == groups["u"] and len(set(groups.values())) == 4  # v has the same sum in another column
    events = [("x", "c", 0, 9, "+", "f", "m1", "p", False), ("y", "c", 0, 9, "+", "f", "m1", "p", False), ("z", "c", 0, 9, "+", "f", "m1", "p", False), ("u", "c", 5, 12, "+", "f", "m2", "p", False), ("v", "c", 0, 9, "+", "f", "m1", "p", True)]
    kind = "event_id string, chrom string, s long, e long, strand string, factor string, family string, peak string, open boolean"
    got = {r.representative: (r.events, r.footprint, r.families, r.policy) for r in routes_.injection_equivalence(sig, spark.createDataFrame(events, kind)).collect()}
    assert got["u"] == (2, "overlapping", "distinct", "exact_set") and got["x"] == (1, "identical", "same", "single_event") and got["v"][2] == "open_only"
    same = [(*e[:6], "m1", *e[7:]) for e in events]
    with pytest.raises(Exception, match="should have collapsed"):
        routes_.injection_equivalence(sig, spark.createDataFrame(same, kind)).collect()


def test_c5_spliced_and_retained_paths(spark):
    exons = "array<struct<s:bigint,e:bigint>>"
    paths = spark.createDataFrame([("g", "whole", [(100, 250)]), ("g", "cut", [(100, 150), (200, 250)])], f"gene_id string, path_id string, exons {exons}")
    reads = [("spliced", [(100, 150), (200, 250)], [(150, 200, 50, 50)], []), ("retained", [(100, 250)], [], []), ("open", [(140, 165)], [], [(150, 200)]), ("other", [(100, 160), (210, 250)], [(160, 210, 50, 40)], [])]
    d = spark.createDataFrame([("g", *r) for r in reads], f"gene_id string, read_id string, blocks {exons}, junctions array<struct<s:bigint,e:bigint,left:bigint,right:bigint>>, censored {exons}")
    got = {r.read_id: (r.compatible, r.fate) for r in compat.compatible_paths(d, paths, 2).withColumn("fate", audit.fate(F.col("compatible"), F.col("n_legal"))).collect()}
    assert got["spliced"] == (["cut"], "informative") and got["retained"] == (["whole"], "informative")
    assert got["open"] == (["cut", "whole"], "full") and got["other"] == ([], "empty")


def test_i3_touching_intervals_merge_and_i4_drops_empty_rests(spark):
    d = spark.createDataFrame([([(5, 9), (1, 3), (3, 5), (20, 21)],)], "a array<struct<s:bigint,e:bigint>>")
    m, s = d.select(intervals.merge_array(F.col("a")), intervals.subtract(F.col("a"), F.lit(2), F.lit(9))).first()
    assert [tuple(x) for x in m] == [(1, 9), (20, 21)] and [tuple(x) for x in s] == [(1, 2), (20, 21)]


def test_i8_owner_has_most_support(spark):
    h = spark.createDataFrame([("h1", "p1", 2.0, 7), ("h2", "p2", 5.0, 7)], "hit_id string, peak_id string, support double, at int")
    r = intervals.unique_owner(h, ["at"]).collect()
    assert len(r) == 1 and r[0].peak_id == "p2" and r[0].peaks == "p1,p2"


def test_i9_collapse_is_transitive(spark):
    h = spark.createDataFrame([("M1", 100, 108), ("M2", 106, 114), ("M3", 112, 120)], "hit_id string, s long, e long").withColumns({"fam": F.lit("family"), "quality": F.lit(1.0)})
    other = spark.createDataFrame([("O", 104, 112, "other", 1.0)], "hit_id string, s long, e long, fam string, quality double")
    got = {r.fam: r.n_hits for r in intervals.collapse_overlaps(h.unionByName(other), ["fam"]).collect()}
    assert got == {"family": 3, "other": 1}


def test_l1_split_is_8_1_1_and_ignores_input_order(spark):
    rows = [(f"{e}_{i}", e) for e in "ab" for i in range(10)]
    one = split.stratified_hash_split(spark.createDataFrame(rows, "cell_id string, stratum string"), 3)
    two = split.stratified_hash_split(spark.createDataFrame(rows[::-1], "cell_id string, stratum string").repartition(7), 3)
    assert sorted(one.collect()) == sorted(two.collect())
    assert [tuple(r)[1:] for r in split.split_summary(one).orderBy("stratum").collect()] == [(8, 1, 1)] * 2


def test_c14_f1_f2_groups_and_exclusive_mass(spark):
    rows = [("t", "g", "p0", 2), ("t", "g", "p0", 3), ("t", "g", "p1", 7), ("t", "g", "p0;p1", 99), ("v", "g", "p0", 1000)]
    ec = spark.createDataFrame(rows, "s string, gene_id string, paths_key string, mass long").withColumn("split", F.when(F.col("s") == "t", "train").otherwise("val"))
    ec = ec.withColumn("fate", F.when(F.col("paths_key") == "p0;p1", "full").otherwise("informative"))
    p = audit.equivalence_patterns(ec).withColumn("paths", F.split("paths_key", ";"))
    assert sorted(r.mass for r in p.collect()) == [5, 7]
    paths = spark.createDataFrame([("g", "p0"), ("g", "p1")], "gene_id string, path_id string")
    groups = identify.observational_groups(p, paths)
    rank = identify.augmented_rank(p, groups).first()
    assert (rank["rank"], rank["groups"], rank["separable"]) == (2, 2, True)
    assert sorted(r.exclusive_mass for r in identify.exclusive_support(p, groups).collect()) == [5, 7]


def test_m2_golden_likelihood(spark):
    logits = spark.createDataFrame([(1, "g", "a", -0.25), (1, "g", "b", 0.75)], "cell_id int, gene_id string, path_id string, logit double")
    ec = spark.createDataFrame([(1, "g", ["a"], 1, 2), (1, "g", ["b"], 1, 2)], "cell_id int, gene_id string, paths array<string>, mass long, n_legal int")
    got = {r.paths[0]: r.nll for r in metrics.compatible_nll(logits, ec).collect()}
    assert math.isclose(got["a"], 1.3132616875182228) and math.isclose(got["b"], 0.3132616875182228)
    shifted = metrics.compatible_nll(logits.withColumn("logit", F.col("logit") + 1000), ec).collect()
    assert all(math.isclose(r.nll, got[r.paths[0]], rel_tol=1e-9) for r in shifted)


def test_m9_ties_and_extreme_logits(spark):
    logits = spark.createDataFrame([(1, "g", "a", 1000.0), (1, "g", "b", 0.0)], "cell_id int, gene_id string, path_id string, logit double")
    counts = spark.createDataFrame([(1, "g", "a", 4), (1, "g", "b", 4)], "cell_id int, gene_id string, path_id string, n long")
    r = metrics.agreement(logits, counts).first()
    assert r.tie_aware == 1 and r.unique_top1 is None and r.ce > 400 and r.ce_clamped < 20


def test_d4_one_path_genes_have_no_row_and_no_cells_no_score(spark):
    counts = spark.createDataFrame([("t1", "g", "a", 9), ("t2", "g", "b", 9), ("t1", "h", "x", 3)], "cell_type string, gene_id string, path_id string, n long")
    paths = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "x")], "gene_id string, path_id string")
    got = usage.dtu_score(counts, paths).collect()
    assert [r.gene_id for r in got] == ["g"] and got[0].n_qualified == 2 and got[0].dtu > 0


def test_f8_two_bubbles_in_a_row(spark):
    """Three paths of a chain of two bubbles: k-l or k-m-l first, then either of two steps from q to r."""
    walks = {"one": "j k l q r", "two": "j k m l q r", "three": "j k l q' r"}
    rows = []
    for path, walk in walks.items():
        stops = [w.strip("'") if w != "q'" else "q" for w in walk.split()]
        for i, (s, d) in enumerate(zip(stops, stops[1:], strict=False)):
            other = "'" if walk.split()[i] == "q'" else ""
            rows.append(("w", path, i, f"{s}{d}{other}", s, d))
    d = spark.createDataFrame(rows, "gene_id string, path_id string, edge_order int, edge_id string, src string, dst string")
    got = sorted((r.choice_id, tuple(r.edges), tuple(sorted(r.paths))) for r in identify.internal_choices(d).collect())
    first = [x for x in got if x[0] == "choice:w:k->l"]
    assert [x[1:] for x in first] == [(("kl",), ("one", "three")), (("km", "ml"), ("two",))]
    second = [x for x in got if x[0] == "choice:w:q->r"]
    assert [x[1:] for x in second] == [(("qr",), ("one", "two")), (("qr'",), ("three",))]


def test_g2_retained_intron_cuts_the_exon(spark):
    from tallgrass.operators import graph

    exons = "array<struct<s:bigint,e:bigint>>"
    paths = [("g", "r", s, [(100, 250)]) for s in "+"] + [("g", "s", "+", [(100, 150), (200, 250)])]
    for strand in "+-":
        d = spark.createDataFrame([(g, p, strand, x) for g, p, _, x in paths], f"gene_id string, path_id string, strand string, exons {exons}")
        nodes, edges, steps = graph.compile_graph(d)
        kinds = sorted((r.lo, r.hi, r.edge_type, r.length_bp) for r in edges.collect())
        assert kinds == [(100, 150, "EXON_CONTINUATION", 50), (150, 200, "RETAINED_INTRON", 50), (150, 200, "SPLICE", 0), (200, 250, "EXON_CONTINUATION", 50)]
        assert nodes.count() == 4 and steps.count() == 6
        assert graph.validate_paths(steps.withColumnsRenamed({"src_node_id": "src", "dst_node_id": "dst"})).count() == 0


def test_s4_s5_s6_text_sources(spark, tmp_path):
    from tallgrass.sources import tables

    (tmp_path / "a.gtf").write_text('#x\nchr1\ts\ttranscript\t101\t200\t.\t+\t.\tgene_id "G1.3"; transcript_id "T1.2"; gene_name "ab";\nchr1\ts\tgene\t1\t2\t.\t+\t.\tgene_id "G1";\n')
    r = tables.read_gtf(spark, str(tmp_path / "a.gtf")).collect()
    assert [tuple(x) for x in r] == [("chr1", "transcript", 100, 200, "+", "G1", "T1", "ab")]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%c\n2 3 2\n1 1 5\n2 3 7\n")
    got = sorted(tuple(x) for x in tables.read_triplets(spark, str(tmp_path / "m.mtx")).where("NOT is_size").drop("is_size").collect())
    assert got == [(0, 0, 5), (1, 2, 7)]
    (tmp_path / "p.bed").write_text("chr1\t5\t9\nchr2\t0\t4\n")
    assert sorted(x.peak_id for x in tables.read_peaks(spark, str(tmp_path / "p.bed")).collect()) == ["chr1:5-9", "chr2:0-4"]
