"""Queries of nulls, seeds and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, regress
from ..operators import matched as mt
from ..operators import reports as rp
from .bindings import BINDINGS, DEALT, query

DEALT |= {"cents"}
BINDINGS |= {
    "seeded": "SELECT p_partkey AS record, p_brand AS stratum, s AS seed, (HASH(s || '|' || p_partkey) % 2001 - 700) / CAST(1000 AS DOUBLE) AS value, p_size AS size, p_retailprice AS weight FROM {part}, (VALUES (1), (2), (3)) v(s)",
    "cents": "SELECT c_custkey AS k, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM {customer}",
    "nulls": """SELECT b AS permutation, s AS seed, sum(CASE WHEN HASH(s || '|' || b || '|' || k) % 2 = 0 THEN cents ELSE -cents END) / CAST(100 * count(*) AS DOUBLE) AS gain
        FROM {cents}, (VALUES (1), (2), (3)) v(s), (SELECT CAST(x * 10 + y AS INT) AS b FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) d(x), (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) e(y)) p GROUP BY 1, 2""",
    "paired": "SELECT s AS seed, sum(cents * (HASH(s || '|' || k) % 3)) / CAST(100 * count(*) AS DOUBLE) AS gain FROM {cents}, (VALUES (1), (2), (3)) v(s) GROUP BY 1",
    "genes": "SELECT p_brand AS gene_id, (HASH(p_brand) % 1000) / CAST(1000 AS DOUBLE) * CASE WHEN HASH(p_brand) % 5 = 0 THEN 0 ELSE 1 END AS dtu, avg(p_retailprice) / 1000 AS a, avg(p_size) / 20 AS b, CAST(count(*) AS BIGINT) AS mass FROM {part} GROUP BY p_brand",
    "readouts": """SELECT s AS seed, v AS model, c_custkey AS cell_id, c_nationkey AS gene_id, c_mktsegment AS segment, CAST(c_custkey % 5 + 1 AS DOUBLE) AS mass, (HASH(s || v || c_custkey) % 1000) / CAST(250 AS DOUBLE) + CASE v WHEN 'edge' THEN 0.2 ELSE 0 END AS nll_sum,
        (HASH('c' || s || v || c_custkey) % 1000) / CAST(1009 AS DOUBLE) AS calibration, CASE WHEN c_custkey % 7 > 0 THEN (HASH('m' || s || v || c_custkey) % 1000) / CAST(1009 AS DOUBLE) END AS agreement FROM {customer}, (VALUES (1), (2), (3)) y(s), (VALUES ('path'), ('edge')) z(v)""",
    "gene_bins": "SELECT n_nationkey AS gene_id, 'region' AS stratifier, 'r' || n_regionkey AS bin, n_regionkey AS bin_order FROM {nation} UNION ALL SELECT n_nationkey, 'name', CASE WHEN length(n_name) > 6 THEN 'long' ELSE 'short' END, CASE WHEN length(n_name) > 6 THEN 1 ELSE 0 END FROM {nation}",
    "effects": "SELECT 'path' AS model, p_partkey AS cell_id, p_size AS gene_id, 'r' || p_partkey AS record_id, p_retailprice - 1400 AS median, p_size / CAST(10 AS DOUBLE) AS iqr, p_size / CAST(50 AS DOUBLE) AS dispersion, CASE WHEN p_partkey % 3 = 0 THEN 'mixed' ELSE 'consistent' END AS direction, CASE WHEN p_size > 25 THEN 'dispersed' ELSE 'stable' END AS magnitude, p_partkey % 11 > 0 AS is_primary FROM {part}",
}


@query("r1_permutations", "cells", """WITH n AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY cell_id) AS k FROM {cells}),
p AS (SELECT stratum, cell_id, k, b AS permutation FROM n, range(0, 100) r(b) WHERE n >= 20), h AS (SELECT stratum, permutation, cell_id AS source, row_number() OVER (PARTITION BY stratum, permutation ORDER BY HASH(permutation || '|' || stratum || '|' || cell_id), cell_id) AS k FROM p)
SELECT p.stratum, p.permutation, p.cell_id AS target, h.source FROM p JOIN h ON h.stratum = p.stratum AND h.permutation = p.permutation AND h.k = p.k""")
def r1(cells):
    return rp.permutation_assignments(cells, 100)


@query("r2_apply_permutation", "cells customer", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY cell_id) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM {cells}),
p AS (SELECT stratum, cell_id, k, b AS permutation FROM n, range(0, 100) r(b) WHERE n >= 20), h AS (SELECT stratum, permutation, cell_id AS source, row_number() OVER (PARTITION BY stratum, permutation ORDER BY HASH(permutation || '|' || stratum || '|' || cell_id), cell_id) AS k FROM p)
SELECT p.permutation, p.cell_id, c_acctbal FROM p JOIN h ON h.stratum = p.stratum AND h.permutation = p.permutation AND h.k = p.k JOIN customer ON c_custkey = source""")
def r2(cells, customer):
    v = customer.select(F.col("c_custkey").alias("cell_id"), "c_acctbal")
    return rp.apply_permutation(v, rp.permutation_assignments(cells, 100)).select("permutation", "cell_id", "c_acctbal")


@query("r3_aggregate_null", "nulls paired", """WITH m AS (SELECT permutation, quantile_cont(gain, 0.5) AS gain FROM {nulls} GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY gain) AS k, count(*) OVER () AS n FROM m)
SELECT count(*) AS permutations, count(*) FILTER (gain > 0) AS positive, round(max(gain) FILTER (k = CAST(ceil(0.95 * (n - 1)) AS BIGINT) + 1), 6) AS null_q, round((SELECT quantile_cont(gain, 0.5) FROM {paired}), 6) AS paired, CASE WHEN count(*) FILTER (gain > 0) >= 40 AND (SELECT quantile_cont(gain, 0.5) FROM {paired}) > max(gain) FILTER (k = CAST(ceil(0.95 * (n - 1)) AS BIGINT) + 1) THEN 'pass' ELSE 'fail' END AS status FROM o""")
def r3(nulls, paired):
    """100 permutations and 3 seeds, as the operator has them; every gain is a sum over all customers, with signs drawn."""
    out = rp.aggregate_null(nulls, paired, 40)
    return out.select("permutations", "positive", *(F.round(c, 6).alias(c) for c in ("null_q", "paired")), "status")


@query("r4_seed_attribution", "seeded", """WITH d AS (SELECT record, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, (3 + abs(sum(sign(value)))) / 6.0 AS agree FROM {seeded} GROUP BY 1)
SELECT record, round(median, 6) AS median, round(iqr, 6) AS iqr, round(agree, 6) AS sign_agreement, CASE WHEN agree = 1 THEN 'consistent' ELSE 'mixed' END AS direction, CASE WHEN median = 0 THEN 'not_estimable' WHEN iqr / abs(median) <= 0.5 THEN 'stable' ELSE 'dispersed' END AS magnitude FROM d""")
def r4(seeded):
    out = rp.seed_attribution(seeded, ["record"])
    return out.select("record", *(F.round(c, 6).alias(c) for c in ("median", "iqr", "sign_agreement")), "direction", "magnitude")


@query("r5_pairwise_spearman", "seeded", """WITH p AS (SELECT a.stratum, a.seed AS seed_a, b.seed AS seed_b, a.value AS x, b.value AS y FROM {seeded} a JOIN {seeded} b ON a.record = b.record AND a.seed < b.seed),
r AS (SELECT *, rank() OVER (PARTITION BY stratum, seed_a, seed_b ORDER BY x) + (count(*) OVER (PARTITION BY stratum, seed_a, seed_b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY stratum, seed_a, seed_b ORDER BY y) + (count(*) OVER (PARTITION BY stratum, seed_a, seed_b, y) - 1) / 2.0 AS ry FROM p)
SELECT stratum, seed_a, seed_b, count(*) AS records, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1, 2, 3""")
def r5(seeded):
    return rp.pairwise_spearman(seeded, ["stratum"]).withColumn("spearman", F.round("spearman", 6))


@query("r6_between_state", "seeded", """WITH m AS (SELECT seed, quantile_cont(value, 0.5) FILTER (size % 2 = 0) AS even, quantile_cont(value, 0.5) FILTER (size % 2 = 1) AS odd FROM {seeded} GROUP BY 1)
SELECT seed, round(even, 6) AS even, round(odd, 6) AS odd, round(even - odd, 6) AS contrast, CASE WHEN min(even - odd) OVER () > 0 OR max(even - odd) OVER () < 0 THEN 'agreed' ELSE 'mixed' END AS status FROM m""")
def r6(seeded):
    out = rp.between_state(seeded.withColumn("state", F.when(F.col("size") % 2 == 0, "even").otherwise("odd")), ["even", "odd"])
    return out.select("seed", *(F.round(c, 6).alias(c) for c in ("even", "odd", "contrast")), "status")


@query("r7_seed_summary", "seeded", """WITH s AS (SELECT seed, avg(value) AS mean_value, max(value) AS top FROM {seeded} GROUP BY 1), l AS (SELECT 'mean_value' AS metric, mean_value AS v FROM s UNION ALL SELECT 'top', top FROM s)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS greatest FROM l GROUP BY 1""")
def r7(seeded):
    s = seeded.groupBy("seed").agg(F.avg("value").cast("double").alias("mean_value"), F.max("value").cast("double").alias("top"))
    return rp.seed_summary(s, ["mean_value", "top"]).select("metric", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "least", "greatest")))


@query("r8_manifest_coverage", "orders", """SELECT CASE grouping_id(o_orderstatus, o_orderpriority) WHEN 3 THEN 'global' WHEN 1 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS stratum_type, coalesce(o_orderstatus, o_orderpriority, '') AS stratum_values,
count(*) AS eligible, count(*) FILTER (o_custkey % 3 = 0) AS selected, round(count(*) FILTER (o_custkey % 3 = 0) / CAST(count(*) AS DOUBLE), 6) AS share FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")
def r8(orders):
    out = mt.checked_coverage(orders, orders.where("o_custkey % 3 = 0").select("o_orderkey"), ["o_orderkey"], [[], ["o_orderstatus"], ["o_orderpriority"]])
    return out.withColumns({"stratum_values": F.array_join("stratum_values", ","), "share": F.round("share", 6)})


@query("r9_compare_models", "seeded", """WITH s AS (SELECT stratum, seed, avg(value - weight / 5000) AS g FROM {seeded} GROUP BY 1, 2) SELECT stratum, round(min(g), 4) AS least_gain, round(avg(g), 4) AS mean_gain, min(g) > 0.02 AS claim FROM s GROUP BY 1""")
def r9(seeded):
    a = seeded.select("record", "seed", "stratum", F.lit("a").alias("model"), F.col("value").cast("double").alias("value"))
    b = seeded.select("record", "seed", "stratum", F.lit("b").alias("model"), (F.col("weight") / 5000).alias("value"))
    out = rp.compare_models(a.unionByName(b), ["stratum"], 0.02)
    return out.select("stratum", F.round("least_gain", 4).alias("least_gain"), F.round("mean_gain", 4).alias("mean_gain"), "claim")


READOUTS = """x AS (SELECT 'overall' AS axis, 'overall' AS level, * FROM {readouts} UNION ALL SELECT 'segment', segment, * FROM {readouts}), o AS (SELECT seed, axis, level, sum(nll_sum) FILTER (model = 'path') / sum(mass) FILTER (model = 'path') AS nll_a, sum(nll_sum) FILTER (model = 'edge') / sum(mass) FILTER (model = 'edge') AS nll_b,
avg(calibration) FILTER (model = 'path') AS calibration_a, avg(calibration) FILTER (model = 'edge') AS calibration_b, sum(calibration * mass) FILTER (model = 'path') / sum(mass) FILTER (model = 'path') AS wa, sum(calibration * mass) FILTER (model = 'edge') / sum(mass) FILTER (model = 'edge') AS wb,
count(*) FILTER (model = 'path') AS rows, sum(mass) FILTER (model = 'path') AS mass FROM x GROUP BY 1, 2, 3)"""


@query("r9_compare_readouts", "readouts", f"""WITH {READOUTS} SELECT seed, axis, level, round(nll_a, 6) AS nll_a, round(nll_b, 6) AS nll_b, round(calibration_a, 6) AS calibration_a, round(calibration_b, 6) AS calibration_b, round(wa, 6) AS weighted_calibration_a, round(wb, 6) AS weighted_calibration_b, rows, mass, round(nll_b - nll_a, 6) AS gain FROM o""")
def r9_readouts(readouts):
    out = mt.compare_readouts(readouts.withColumn("ec_id", F.lit("e")), "path", "edge", ["segment"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith(("nll", "cal", "wei", "gain"))})


@query("r9_readout_claim", "readouts", f"WITH {READOUTS} SELECT count(*) AS seeds, round(min(nll_b - nll_a), 6) AS least_gain, round(avg(nll_b - nll_a), 6) AS mean_gain, bool_and(nll_b - nll_a > 0.01) AS claim FROM o WHERE axis = 'overall'")
def r9_claim(readouts):
    out = mt.readout_claim(mt.compare_readouts(readouts.withColumn("ec_id", F.lit("e")), "path", "edge", ["segment"]), 0.01)
    return out.withColumns({c: F.round(c, 6) for c in ("least_gain", "mean_gain")})


@query("r6_state_contrasts", "seeded", """WITH p AS (SELECT * FROM (SELECT DISTINCT stratum FROM {seeded}) s, (VALUES ('even', 'odd'), ('even', 'none')) v(state_a, state_b)), d AS (SELECT *, CASE WHEN size % 2 = 0 THEN 'even' ELSE 'odd' END AS state FROM {seeded}),
m AS (SELECT stratum, state, seed, quantile_cont(value, 0.5) AS m, count(*) AS cells FROM d GROUP BY 1, 2, 3), c AS (SELECT p.stratum, state_a, state_b, max(coalesce(a.cells, 0)) AS cells_a, max(coalesce(b.cells, 0)) AS cells_b, list(a.m - b.m ORDER BY a.seed) AS ds FROM p LEFT JOIN m a ON a.stratum = p.stratum AND a.state = state_a LEFT JOIN m b ON b.stratum = p.stratum AND b.state = state_b AND b.seed = a.seed GROUP BY 1, 2, 3),
q AS (SELECT *, least(cells_a, cells_b) >= 8 AS enough, list_aggregate(ds, 'quantile_cont', 0.5) AS med, list_aggregate(ds, 'quantile_cont', 0.75) - list_aggregate(ds, 'quantile_cont', 0.25) AS iqr, list_min(ds) > 0.001 OR list_max(ds) < -0.001 AS one FROM c)
SELECT stratum, state_a, state_b, cells_a, cells_b, CASE WHEN enough THEN round(med, 6) END AS median, CASE WHEN enough THEN round(iqr / greatest(abs(med), 0.05), 6) END AS dispersion, CASE WHEN NOT enough THEN 'not_estimable' WHEN NOT one THEN 'direction_not_stable' WHEN abs(med) < 0.05 THEN 'below_floor' WHEN iqr / greatest(abs(med), 0.05) > 0.5 THEN 'magnitude_not_stable' ELSE 'stable' END AS status FROM q""")
def r6_states(seeded):
    d = seeded.select("stratum", "seed", F.col("record").alias("cell_id"), F.when(F.col("size") % 2 == 0, "even").otherwise("odd").alias("state"), "value")
    out = mt.state_contrasts(d, ["stratum"], [("even", "odd"), ("even", "none")], 8, 0.001, 0.05, 0.5)
    return out.drop("contrasts").withColumns({c: F.round(c, 6) for c in ("median", "dispersion")})


@query("r10_prediction_strata", "readouts nation", """WITH x AS (SELECT r.*, CAST(n_regionkey AS VARCHAR) AS region FROM {readouts} r JOIN nation ON n_nationkey = gene_id) SELECT model, seed, 'region' AS axis, region AS level, count(*) AS rows, count(DISTINCT gene_id) AS genes, sum(mass) AS mass, round(sum(nll_sum) / sum(mass), 6) AS nll, round(avg(calibration), 6) AS mean_calibration FROM x GROUP BY 1, 2, 4""")
def r10_prediction(readouts, nation):
    strata = nation.select(F.col("n_nationkey").alias("gene_id"), F.col("n_regionkey").alias("region"))
    return mt.prediction_strata(readouts, strata, ["region"], ["calibration"]).withColumns({"nll": F.round("nll", 6), "mean_calibration": F.round("mean_calibration", 6)})


@query("r11_attribution_strata", "effects", """WITH x AS (SELECT *, CASE WHEN gene_id <= 10 THEN 'small' ELSE 'large' END AS level FROM {effects} WHERE is_primary) SELECT model, 'burden' AS axis, level, count(*) AS records, count(DISTINCT (cell_id, gene_id)) AS cell_genes, count(*) FILTER (direction = 'consistent') AS direction_stable, count(*) FILTER (magnitude = 'stable') AS magnitude_stable,
round(quantile_cont(abs(median), 0.5), 6) AS median_size, round(quantile_cont(iqr, 0.5), 6) AS median_iqr, round(quantile_cont(dispersion, 0.5), 6) AS median_dispersion FROM x GROUP BY 1, 3""")
def r11_attribution(effects):
    strata = effects.select("gene_id").distinct().withColumn("burden", F.when(F.col("gene_id") <= 10, "small").otherwise("large"))
    out = mt.attribution_strata(effects.withColumnRenamed("is_primary", "primary"), strata, ["burden"])
    return out.withColumns({c: F.round(c, 6) for c in ("median_size", "median_iqr", "median_dispersion")})


SENSITIVITY = """v AS (SELECT model, seed, gene_id, gene_id % 3 = 0 AS high, mass AS total, 'agreement' AS metric, agreement AS v FROM {readouts} UNION ALL SELECT model, seed, gene_id, gene_id % 3 = 0, mass, 'calibration', calibration FROM {readouts}),
g AS (SELECT * FROM (SELECT DISTINCT model, seed FROM v) a, (SELECT DISTINCT stratifier, bin, bin_order FROM {gene_bins}) b, (VALUES (true), (false)) h(high), (VALUES ('agreement'), ('calibration')) m(metric)),
o AS (SELECT model, seed, stratifier, bin, high, metric, count(DISTINCT v.gene_id) AS genes, count(*) AS rows, sum(total) AS mass, count(v) AS defined, avg(v) AS macro, sum(v * total) / sum(total) FILTER (v IS NOT NULL) AS weighted FROM v JOIN {gene_bins} b ON b.gene_id = v.gene_id GROUP BY 1, 2, 3, 4, 5, 6),
e AS (SELECT g.*, coalesce(genes, 0) AS genes, coalesce(rows, 0) AS rows, coalesce(mass, 0) AS mass, coalesce(defined, 0) AS defined, macro, weighted FROM g LEFT JOIN o ON o.model = g.model AND o.seed = g.seed AND o.stratifier = g.stratifier AND o.bin = g.bin AND o.high = g.high AND o.metric = g.metric),
s AS (SELECT * EXCLUDE (macro, weighted), 'macro' AS aggregation, macro AS value FROM e UNION ALL SELECT * EXCLUDE (macro, weighted), 'weighted', weighted FROM e)"""


def sensitivity(readouts, bins):
    d = readouts.select("model", "seed", "cell_id", "gene_id", (F.col("gene_id") % 3 == 0).alias("high"), F.col("mass").alias("total"), "agreement", "calibration")
    return mt.seed_sensitivity(d, bins, ["agreement", "calibration"])


@query("r13_seed_sensitivity", "readouts gene_bins", f"WITH {SENSITIVITY} SELECT model, seed, stratifier, bin, bin_order, high, metric, genes, rows, mass, defined, aggregation, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'not_estimable' ELSE 'estimable' END AS status FROM s")
def r13_seeds(readouts, bins):
    return sensitivity(readouts, bins).withColumn("value", F.round("value", 6))


@query("r13_across_seeds", "readouts gene_bins", f"""WITH {SENSITIVITY} SELECT model, stratifier, bin, bin_order, high, metric, aggregation, count(*) AS seeds, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(max(value) - min(value), 6) AS range, min(genes) AS genes, min(rows) AS rows, min(mass) AS mass, min(defined) AS defined, CASE WHEN count(value) < count(*) THEN 'not_estimable' ELSE 'estimable' END AS status FROM s GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def r13_across(readouts, bins):
    return mt.across_seeds(sensitivity(readouts, bins)).withColumns({c: F.round(c, 6) for c in ("mean", "sd", "range")})


@query("r10_axis_strata", "seeded", """WITH l AS (SELECT 'stratum' AS axis, stratum AS level, * EXCLUDE (stratum) FROM {seeded} UNION ALL SELECT 'size', CAST(size AS VARCHAR), * EXCLUDE (stratum) FROM {seeded})
SELECT axis, level, seed, count(*) AS rows, round(sum(value * weight) / sum(weight), 8) AS ratio, round(avg(value), 8) AS mean_value FROM l GROUP BY 1, 2, 3""")
def r10(seeded):
    d = seeded.withColumn("vw", F.col("value") * F.col("weight"))
    out = rp.axis_strata(d, ["stratum", "size"], ["seed"], "vw", "weight", ["value"])
    return out.select("axis", "level", "seed", "rows", F.round("ratio", 8).alias("ratio"), F.round("mean_value", 8).alias("mean_value"))


@query("r11_density_strata", "molecules", """WITH c AS (SELECT gene_id, cell_id, count(*) AS density, avg(n) AS v FROM {molecules} GROUP BY 1, 2) SELECT CASE WHEN density <= 2 THEN '2' WHEN density = 3 THEN '3' WHEN density <= 5 THEN '4-5' WHEN density <= 10 THEN '6-10' WHEN density <= 20 THEN '11-20' ELSE '>20' END AS level,
count(*) AS rows, round(avg(v), 6) AS mean_v FROM c GROUP BY 1""")
def r11(molecules):
    c = molecules.groupBy("gene_id", "cell_id").agg(F.count("*").alias("density"), F.avg("n").alias("v"))
    out = rp.axis_strata(c.withColumn("density", rp.path_count_bin(F.col("density"))), ["density"], [], "v", "v", ["v"])
    return out.select("level", "rows", F.round("mean_v", 6).alias("mean_v"))


@query("r12_support_bins", "counts", "WITH t AS (SELECT path_id, sum(n) AS n, count(*) AS k FROM {counts} GROUP BY 1) SELECT path_id, CASE WHEN k <= 2 THEN '2' WHEN k = 3 THEN '3' WHEN k <= 5 THEN '4-5' WHEN k <= 10 THEN '6-10' WHEN k <= 20 THEN '11-20' ELSE '>20' END AS path_bin, CAST(floor(log2(n)) AS INTEGER) AS mass_bin FROM t")
def r12(counts):
    t = counts.groupBy("path_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    return t.select("path_id", rp.path_count_bin(F.col("k")).alias("path_bin"), rp.log2_bin(F.col("n")).alias("mass_bin"))


@query("r13_support_sensitivity", "part", """WITH p AS (SELECT p_brand AS brand, p_type AS type, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(p_partkey AS DOUBLE) AS w FROM part), g AS (SELECT * FROM (SELECT DISTINCT brand FROM p) b, (VALUES ('ECONOMY'), ('NONE')) t(type), (VALUES ('size'), ('price')) m(metric)),
l AS (SELECT brand, type, 'size' AS metric, size AS v, w FROM p UNION ALL SELECT brand, type, 'price', price, w FROM p), o AS (SELECT brand, type, metric, count(*) AS rows, avg(v) AS macro, sum(v * w) / nullif(sum(w), 0) AS weighted FROM l GROUP BY 1, 2, 3)
SELECT g.brand, g.type, g.metric, coalesce(rows, 0) AS rows, round(macro, 4) AS macro, round(weighted, 4) AS weighted, CASE WHEN rows > 0 THEN 'estimable' ELSE 'not_estimable' END AS status FROM g LEFT JOIN o ON o.brand = g.brand AND o.type = g.type AND o.metric = g.metric""")
def r13(part):
    p = part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_partkey").cast("double").alias("weight"))
    out = rp.support_sensitivity(p, {"brand": p.select("brand").distinct(), "type": ["ECONOMY", "NONE"]}, ["size", "price"])
    return out.select("brand", "type", "metric", "rows", F.round("macro", 4).alias("macro"), F.round("weighted", 4).alias("weighted"), "status")


@query("r14_quantile_bins", "part", """WITH e AS (SELECT unnest(list_distinct(quantile_cont(p_retailprice, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edge FROM part) SELECT p_partkey, CAST(greatest(count(*) FILTER (edge < p_retailprice), 1) - 1 AS INTEGER) AS bin FROM part, e GROUP BY 1""")
def r14(part):
    return rp.quantile_bins(part.select("p_partkey", "p_retailprice"), "p_retailprice", 5).select("p_partkey", "bin")


@query("r15_stratified_gap", "genes", """WITH c AS (SELECT quantile_cont(dtu, 0.9) AS cut, sum(mass) AS am FROM {genes}), x AS (SELECT g.*, cut, am FROM {genes} g, c),
s AS (SELECT '=0' AS stratum, * FROM x WHERE dtu = 0 UNION ALL SELECT '(0,.1]', * FROM x WHERE dtu > 0 AND dtu <= 0.1 UNION ALL SELECT '(.1,.35]', * FROM x WHERE dtu > 0.1 AND dtu <= 0.35 UNION ALL SELECT '(.35,.65]', * FROM x WHERE dtu > 0.35 AND dtu <= 0.65 UNION ALL SELECT '>.65', * FROM x WHERE dtu > 0.65 UNION ALL SELECT 'top', * FROM x WHERE dtu >= cut)
SELECT stratum, count(*) AS genes, round(avg(b - a), 6) AS macro_gap, round(sum((b - a) * mass) / sum(mass), 6) AS weighted_gap, round(sum(mass) / CAST(max(am) AS DOUBLE), 6) AS mass_share FROM s GROUP BY 1""")
def r15(genes):
    out = rp.stratified_gap(genes.withColumns({c: F.col(c).cast("double") for c in ("dtu", "a", "b")}))
    return out.select("stratum", "genes", *(F.round(c, 6).alias(c) for c in ("macro_gap", "weighted_gap", "mass_share")))


@query("r16_bootstrap_ci", "supplier", """WITH d AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), w AS (SELECT rep, HASH('5|' || rep || '|' || i) % n AS j FROM d, range(0, 4000) r(rep)),
m AS (SELECT rep, avg(x) AS m FROM w JOIN d ON d.i = w.j GROUP BY 1) SELECT round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi, round((SELECT avg(x) FROM d), 4) AS mean, quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS significant FROM m""")
def r16(supplier):
    d = contracts.numbered(supplier.select("s_suppkey", "s_acctbal"), ["s_suppkey"])
    return rp.bootstrap_ci(d, "s_acctbal", 4000, 5).select(*(F.round(c, 4).alias(c) for c in ("lo", "hi", "mean")), "significant")


@query("r16_resampled_intervals", "part")
def r16_ratio(part):
    """4,000 resamples of all parts: the mean of price differences, and a ratio of sums."""
    d = part.select("p_partkey", (F.col("p_retailprice") - 1400).alias("delta"), (F.col("p_size") - 25).alias("contrib"), F.col("p_size").alias("mass"))
    return regress.resampled_intervals(contracts.numbered(d, ["p_partkey"]), "delta", "contrib", "mass")


@query("r17_epoch_join", "events", """WITH d AS (SELECT CAST(date_diff('day', TIMESTAMP '2000-01-01', date_trunc('day', ts)) AS INTEGER) AS epoch, avg(value) FILTER (event_type = 'view') AS m, count(*) FILTER (event_type = 'view') AS rate, avg(value) FILTER (event_type = 'click') AS mb FROM events GROUP BY 1)
SELECT epoch, round(mb - m, 6) AS gap, coalesce(rate < lag(rate) OVER (ORDER BY epoch), false) AS rate_drop FROM d WHERE m IS NOT NULL AND mb IS NOT NULL""")
def r17(events):
    d = events.withColumn("epoch", F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")))
    one = lambda k: d.where(F.col("event_type") == k).groupBy("epoch").agg(F.avg("value").alias("metric"), F.count("*").alias("rate"))
    return rp.epoch_join(one("view"), one("click")).withColumn("gap", F.round("gap", 6))
