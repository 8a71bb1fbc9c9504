"""Queries of cell context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import ordered_sum
from ..operators import context as cx
from .bindings import BINDINGS, BUILT, query

BINDINGS |= {
    "usage": "SELECT user_id AS cell_id, event_type AS gene_id, count(*) AS n FROM {events} GROUP BY 1, 2",
    "members": "SELECT DISTINCT event_type AS gene_id, CASE WHEN event_type IN ('view', 'click') THEN 'browse' ELSE 'act' END AS entity_id FROM {events}",
    "user_split": "SELECT DISTINCT user_id AS cell_id, CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM {events}",
    "user_mass": "SELECT user_id AS cell_id, count(*) AS mass FROM {events} GROUP BY 1",
    "access": "SELECT user_id AS cell_id, CAST(event_id % 4 AS BIGINT) AS peak_id, ln(1 + sum(value)) AS access FROM {events} GROUP BY 1, 2",
}


def access(events):
    """The rows of `access`; values are added by event, so that equal users tie at a quantile in each use of the table."""
    d = events.select(F.col("user_id").alias("cell_id"), (F.col("event_id") % 4).alias("peak_id"), "event_id", F.col("value").cast("double").alias("value"))
    return ordered_sum(d, ["cell_id", "peak_id"], "value", "event_id").select("cell_id", "peak_id", F.log(1 + F.col("value")).alias("access"))


BUILT["access"] = ("events", access)

ACT = """lib AS (SELECT cell_id, sum(n) AS library FROM {usage} GROUP BY 1), own AS (SELECT cell_id, entity_id, sum(n) AS raw FROM {usage} u JOIN {members} m ON m.gene_id = u.gene_id GROUP BY 1, 2),
act AS (SELECT l.cell_id, e.entity_id, CAST(coalesce(raw, 0) AS BIGINT) AS raw, ln(1 + 10000.0 * coalesce(raw, 0) / library) AS activity FROM lib l, (SELECT DISTINCT entity_id FROM {members}) e LEFT JOIN own o ON o.cell_id = l.cell_id AND o.entity_id = e.entity_id)"""


@query("x1_cp10k_log1p", "usage", "SELECT cell_id, gene_id, round(ln(1 + 10000.0 * n / sum(n) OVER (PARTITION BY cell_id)), 6) AS value FROM {usage}")
def x1(usage):
    return cx.cp10k_log1p(usage).select("cell_id", "gene_id", F.round("value", 6).alias("value"))


@query("x2_entity_activity", "usage members", f"WITH {ACT} SELECT cell_id, entity_id, raw, round(activity, 6) AS activity, true AS observed FROM act")
def x2(usage, members):
    return cx.entity_activity(usage, members, usage).withColumn("activity", F.round("activity", 6))


KNN = """q AS (SELECT vec_id AS query_id, label AS stratum, embedding AS v FROM embeddings WHERE vec_id % 2 = 1), a AS (SELECT vec_id AS neighbor_id, label AS stratum, embedding AS av FROM embeddings WHERE vec_id % 2 = 0 QUALIFY count(*) OVER (PARTITION BY label) >= 5),
d AS (SELECT query_id, q.stratum, neighbor_id, sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(CAST(v[i] AS DOUBLE) - CAST(av[i] AS DOUBLE), 2)))) AS distance FROM q JOIN a ON a.stratum = q.stratum),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) x WHERE rank <= 5),
th AS (SELECT stratum, quantile_cont(distance, 0.99) AS lim, greatest(quantile_cont(distance, 0.5), 1e-6) AS temp FROM nn WHERE rank = 1 AND query_id % 5 > 0 GROUP BY 1),
ww AS (SELECT query_id, nn.stratum, neighbor_id, distance, exp(-distance / temp) / sum(exp(-distance / temp)) OVER (PARTITION BY query_id) AS weight FROM nn JOIN th ON th.stratum = nn.stratum WHERE distance <= lim)"""


def knn_sides(embeddings):
    e = embeddings.select("vec_id", F.col("label").alias("stratum"), F.col("embedding").alias("v"))
    return e.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "query_id"), e.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "neighbor_id")


def neighbours(embeddings):
    return cx.knn_map(*knn_sides(embeddings), 5, 256)


def weights(embeddings):
    nn = neighbours(embeddings)
    split = embeddings.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 5 > 0, "train").otherwise("val").alias("split"))
    return cx.admit_weights(nn, cx.knn_threshold(nn, split))


@query("x3_knn_map", "embeddings", f"WITH {KNN} SELECT query_id, stratum, neighbor_id, round(distance, 5) AS distance, rank FROM nn")
def x3(embeddings):
    return neighbours(embeddings).withColumn("distance", F.round("distance", 5))


@query("x3_knn_strata", "embeddings", """WITH q AS (SELECT label AS stratum, count(*) AS queries, count(embedding) AS with_vector FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1), a AS (SELECT label AS stratum, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 AND embedding IS NOT NULL GROUP BY 1)
SELECT q.stratum, queries, coalesce(n, 0) AS atlas_rows, CASE WHEN q.stratum IS NULL THEN 'no_stratum' WHEN coalesce(n, 0) < 30 THEN 'fewer_atlas_rows_than_k' WHEN with_vector < queries THEN 'queries_without_vector' END AS reason FROM q LEFT JOIN a ON a.stratum = q.stratum""")
def x3_strata(embeddings):
    return cx.knn_strata(*knn_sides(embeddings), 30)


@query("x3_knn_pruning", "embeddings")
def x3_pruning(embeddings):
    return cx.knn_pruning(*knn_sides(embeddings), 5, 64)


@query("x4_knn_threshold", "embeddings", f"WITH {KNN} SELECT stratum, round(lim, 5) AS limit_, round(temp, 5) AS temperature FROM th")
def x4(embeddings):
    split = embeddings.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 5 > 0, "train").otherwise("val").alias("split"))
    return cx.knn_threshold(neighbours(embeddings), split).select("stratum", F.round("limit", 5).alias("limit_"), F.round("temperature", 5).alias("temperature"))


@query("x5_admit_weights", "embeddings", f"WITH {KNN} SELECT query_id, neighbor_id, round(weight, 5) AS weight FROM ww")
def x5(embeddings):
    return weights(embeddings).select("query_id", "neighbor_id", F.round("weight", 5).alias("weight"))


@query("x6_mapping_audit", "embeddings", f"""WITH {KNN}, b AS (SELECT query_id, count(*) AS k, 1 / sum(weight * weight) AS ess, max(weight) AS mw, max(distance) AS farthest FROM ww GROUP BY 1)
SELECT q.query_id, coalesce(k, 0) AS neighbors, round(ess, 4) AS ess, round(ess / k, 4) AS evenness, round(mw, 4) AS max_weight, concat_ws(',', CASE WHEN k IS NULL THEN 'no_neighbors' END, CASE WHEN k > 4 THEN 'too_many_neighbors' END, CASE WHEN farthest > 9 THEN 'far' END) AS reasons, coalesce(k, 0) / 4.0 AS coverage FROM q LEFT JOIN b ON b.query_id = q.query_id""")
def x6(embeddings):
    q = embeddings.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"))
    out = cx.mapping_audit(q, weights(embeddings), 4, 9.0)
    return out.select("query_id", "neighbors", *(F.round(c, 4).alias(c) for c in ("ess", "evenness", "max_weight")), "reasons", "coverage")


@query("x7_map_access", "embeddings", f"WITH {KNN} SELECT query_id, neighbor_id % 3 AS peak_id, round(sum(weight * ln(1 + neighbor_id)), 4) AS access FROM ww GROUP BY 1, 2")
def x7(embeddings):
    n = F.col("vec_id")
    return cx.map_access(weights(embeddings), embeddings.select(n.alias("neighbor_id"), (n % 3).alias("peak_id"), F.log1p(n).alias("value"))).withColumn("access", F.round("access", 4))


@query("x8_stage_map", "orders", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY 1")
def x8(orders):
    return cx.stage_map(orders, "o_custkey", "o_orderstatus")


GATES = f"""{ACT}, keys AS (SELECT 'r' || entity_id AS gate_key_id, 'RNA' AS ch, entity_id, NULL::BIGINT AS peak_id FROM (SELECT DISTINCT entity_id FROM {{members}}) m UNION ALL SELECT 'o' || p, 'OPEN', NULL, p FROM range(0, 4) r(p)
 UNION ALL SELECT 'd' || entity_id || p, 'DNA', entity_id, p FROM (SELECT DISTINCT entity_id FROM {{members}}) m, range(0, 4) r(p)),
raw AS (SELECT gate_key_id, cell_id, activity AS raw FROM keys k JOIN act a ON a.entity_id = k.entity_id WHERE ch = 'RNA' UNION ALL SELECT gate_key_id, cell_id, access FROM keys k JOIN {{access}} c ON c.peak_id = k.peak_id WHERE ch = 'OPEN'
 UNION ALL SELECT gate_key_id, a.cell_id, activity * access FROM keys k JOIN act a ON a.entity_id = k.entity_id JOIN {{access}} c ON c.cell_id = a.cell_id AND c.peak_id = k.peak_id WHERE ch = 'DNA'),
tr AS (SELECT raw.*, CAST(mass AS DOUBLE) AS w FROM raw JOIN {{user_mass}} m ON m.cell_id = raw.cell_id JOIN {{user_split}} s ON s.cell_id = raw.cell_id WHERE split = 'train' AND mass > 0),
mu AS (SELECT gate_key_id, sum(raw * w) / sum(w) AS mean FROM tr GROUP BY 1),
cu AS (SELECT *, sum(w) OVER (PARTITION BY gate_key_id ORDER BY raw) AS cum, sum(w) OVER (PARTITION BY gate_key_id) AS tot FROM tr),
fit AS (SELECT cu.gate_key_id, max(mean) AS mean, sqrt(sum(w * pow(raw - mean, 2)) / sum(w)) AS sd, pow(sum(w), 2) / sum(w * w) AS n_eff, min(raw) AS lo, max(raw) AS hi, min(raw) FILTER (cum >= 0.05 * tot) AS q05, min(raw) FILTER (cum >= 0.95 * tot) AS q95, count(*) AS n_valid, sum(w) AS informative FROM cu JOIN mu ON mu.gate_key_id = cu.gate_key_id GROUP BY 1)"""
GATE_NEEDS = "usage members access"


def gate_keys(members):
    e = members.select("entity_id").distinct()
    p = members.sparkSession.range(4).select(F.col("id").alias("peak_id"))
    rna = e.select(F.concat(F.lit("r"), "entity_id").alias("gate_key_id"), F.lit("RNA").alias("channel"), "entity_id", F.lit(None).cast("long").alias("peak_id"))
    opened = p.select(F.concat(F.lit("o"), "peak_id").alias("gate_key_id"), F.lit("OPEN").alias("channel"), F.lit(None).cast("string").alias("entity_id"), "peak_id")
    dna = e.crossJoin(F.broadcast(p)).select(F.concat(F.lit("d"), "entity_id", "peak_id").alias("gate_key_id"), F.lit("DNA").alias("channel"), "entity_id", "peak_id")
    return rna.unionByName(opened).unionByName(dna)


def raw_table(usage, members, access):
    return cx.raw_gates(gate_keys(members), cx.entity_activity(usage, members, usage), access)


@query("x9_raw_gates", GATE_NEEDS, f"WITH {GATES} SELECT gate_key_id, cell_id, round(raw, 6) AS raw FROM raw")
def x9(usage, members, access):
    return raw_table(usage, members, access).select("gate_key_id", "cell_id", F.round("raw", 6).alias("raw"))


FIT = "gate_key_id, round(mean, 5) AS mean, round(sd, 5) AS sd, round(n_eff, 4) AS n_eff, round(q05, 5) AS q05, round(q95, 5) AS q95, n_valid, CAST(informative AS BIGINT) AS informative"
#: Cells, effective cells, molecules and deviation that a gate needs.
NEEDS = {"least_cells": 90, "least_n": 100, "least_mass": 900, "least_sd": 0.2}
ACTIVE = f"(n_valid >= {NEEDS['least_cells']} AND n_eff >= {NEEDS['least_n']} AND informative >= {NEEDS['least_mass']} AND sd > {NEEDS['least_sd']})"


@query("x10_fit_gates", f"{GATE_NEEDS} user_mass user_split", f"""WITH {GATES} SELECT {FIT}, concat_ws(',', CASE WHEN n_valid < {NEEDS['least_cells']} THEN 'few_cells' END, CASE WHEN n_eff < {NEEDS['least_n']} THEN 'few_effective_cells' END,
CASE WHEN informative < {NEEDS['least_mass']} THEN 'few_molecules' END, CASE WHEN sd <= {NEEDS['least_sd']} THEN 'no_variance' END) AS reasons FROM fit""")
def x10(usage, members, access, mass, split):
    out = cx.fit_gates(raw_table(usage, members, access), mass, split, **NEEDS)
    return out.select("gate_key_id", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round("n_eff", 4).alias("n_eff"), F.round("q05", 5).alias("q05"), F.round("q95", 5).alias("q95"), "n_valid", F.col("informative").cast("long").alias("informative"), "reasons")


APPLY = f"""SELECT raw.gate_key_id, cell_id, round(CASE WHEN {ACTIVE} THEN (raw - mean) / sd ELSE 0 END, 4) AS gate, {ACTIVE} AND (raw < lo OR raw > hi) AS out_of_range, {ACTIVE} AND (raw < q05 OR raw > q95) AS out_of_quantiles FROM raw JOIN fit ON fit.gate_key_id = raw.gate_key_id"""


@query("x11_apply_gates", f"{GATE_NEEDS} user_mass user_split", f"WITH {GATES} {APPLY}")
def x11(usage, members, access, mass, split):
    raw = raw_table(usage, members, access)
    out = cx.apply_gates(raw, cx.fit_gates(raw, mass, split, **NEEDS))
    return out.select("gate_key_id", "cell_id", F.round("gate", 4).alias("gate"), "out_of_range", "out_of_quantiles")


@query("x12_gate_pipeline", f"{GATE_NEEDS} user_mass user_split", f"WITH {GATES}, z AS ({APPLY.replace(', 4) AS gate', ', 12) AS gate')}) SELECT cell_id, count(*) AS gates, round(sum(abs(gate)), 3) AS strength, count(*) FILTER (out_of_quantiles) AS unusual FROM z GROUP BY 1")
def x12(usage, members, access, mass, split):
    raw = raw_table(usage, members, access)
    z = cx.apply_gates(raw, cx.fit_gates(raw, mass, split, **NEEDS))
    return z.groupBy("cell_id").agg(F.count("*").alias("gates"), F.round(F.sum(F.abs("gate")), 3).alias("strength"), F.count_if("out_of_quantiles").alias("unusual"))


@query("x13_gate_collinearity", f"{GATE_NEEDS} user_mass user_split", f"""WITH {GATES}, m AS (SELECT tr.gate_key_id, tr.cell_id, raw, w FROM tr JOIN fit ON fit.gate_key_id = tr.gate_key_id WHERE {ACTIVE}),
p AS (SELECT a.gate_key_id AS gate_a, b.gate_key_id AS gate_b, sum(a.w) AS sw, sum(a.w * a.raw) AS sx, sum(a.w * b.raw) AS sy, sum(a.w * a.raw * a.raw) AS sxx, sum(a.w * b.raw * b.raw) AS syy, sum(a.w * a.raw * b.raw) AS sxy FROM m a JOIN m b ON a.cell_id = b.cell_id AND a.gate_key_id < b.gate_key_id GROUP BY 1, 2),
r AS (SELECT gate_a, gate_b, (sxy / sw - sx * sy / sw / sw) / sqrt((sxx / sw - sx * sx / sw / sw) * (syy / sw - sy * sy / sw / sw)) AS r FROM p)
SELECT gate_a, gate_b, round(r, 4) AS r, CASE WHEN abs(r) > 1 - 1e-9 THEN 'perfect' WHEN abs(r) >= 0.95 THEN 'near' ELSE 'distinct' END AS status FROM r""")
def x13(usage, members, access, mass, split):
    raw = raw_table(usage, members, access)
    fit = cx.fit_gates(raw, mass, split, **NEEDS)
    keys = gate_keys(members).withColumn("gene_id", F.lit("g")).join(fit.select("gate_key_id", "active"), "gate_key_id")
    return cx.gate_collinearity(raw, keys, mass, split).select("gate_a", "gate_b", F.round("r", 4).alias("r"), "status")


@query("x15_perturbed_gates", f"{GATE_NEEDS} user_mass user_split", f"""WITH {GATES}, cg AS (SELECT 'a' || cell_id AS change_id, cell_id, 'activity' AS kind, 'browse' AS src, 2.5::DOUBLE AS value FROM lib UNION ALL SELECT 'o' || cell_id, cell_id, 'access', '2', 0.5 FROM {{access}} WHERE peak_id = 2),
t AS (SELECT change_id, cg.cell_id, k.gate_key_id, CASE WHEN k.ch = 'DNA' THEN value * CASE WHEN kind = 'activity' THEN c.access ELSE a.activity END ELSE value END AS raw FROM cg JOIN keys k ON (kind = 'activity' AND k.entity_id = src) OR (kind = 'access' AND CAST(k.peak_id AS VARCHAR) = src)
 LEFT JOIN {{access}} c ON c.cell_id = cg.cell_id AND c.peak_id = k.peak_id LEFT JOIN act a ON a.cell_id = cg.cell_id AND a.entity_id = k.entity_id),
z AS (SELECT change_id, cell_id, t.gate_key_id, raw, raw IS NOT NULL AS observed, {ACTIVE} AS active, CASE WHEN {ACTIVE} AND raw IS NOT NULL THEN (raw - mean) / sd ELSE 0 END AS gate, coalesce({ACTIVE} AND (raw < lo OR raw > hi), false) AS out_of_range, coalesce({ACTIVE} AND (raw < q05 OR raw > q95), false) AS out_of_quantiles FROM t JOIN fit ON fit.gate_key_id = t.gate_key_id)
SELECT change_id, cell_id, gate_key_id, round(raw, 6) AS raw, round(gate, 4) AS gate, observed, active, out_of_range, out_of_quantiles,
CASE WHEN bool_or(out_of_range OR out_of_quantiles) OVER (PARTITION BY change_id) THEN 'model_extrapolation' WHEN bool_or(NOT observed OR NOT active) OVER (PARTITION BY change_id) THEN 'missing_context' ELSE 'supported' END AS support FROM z""")
def x15_gates(usage, members, access, mass, split):
    """Every cell with its browsing activity set, and every cell with peak 2 with its accessibility set."""
    act = cx.entity_activity(usage, members, usage)
    fit = cx.fit_gates(cx.raw_gates(gate_keys(members), act, access), mass, split, **NEEDS)
    change = lambda d, name, kind, source, value: d.select(F.concat(F.lit(name), "cell_id").alias("change_id"), "cell_id", F.lit(kind).alias("kind"), F.lit(source).alias("source_id"), F.lit(value).alias("value"))
    changes = change(usage.select("cell_id").distinct(), "a", "activity", "browse", 2.5).unionByName(change(access.where("peak_id = 2"), "o", "access", "2", 0.5))
    return cx.perturbed_gates(changes, gate_keys(members), act, access, fit).withColumns({"raw": F.round("raw", 6), "gate": F.round("gate", 4)})


@query("x15_perturb_source", f"{GATE_NEEDS}", f"""WITH {GATES} SELECT gate_key_id, cell_id, round(raw, 6) AS raw FROM raw WHERE cell_id <> 7 OR NOT contains(gate_key_id, 'browse')
UNION ALL SELECT k.gate_key_id, 7, round(CASE WHEN ch = 'DNA' THEN 2.5 * access ELSE 2.5 END, 6) FROM keys k LEFT JOIN {{access}} c ON c.peak_id = k.peak_id AND c.cell_id = 7 WHERE k.entity_id = 'browse' AND EXISTS (SELECT 1 FROM act WHERE cell_id = 7) AND (ch = 'RNA' OR c.cell_id IS NOT NULL)""")
def x15(usage, members, access):
    act = cx.entity_activity(usage, members, usage)
    change = act.sparkSession.createDataFrame([(7, "browse", 2.5)], "cell_id long, entity_id string, activity double")
    return cx.raw_gates(gate_keys(members), cx.overridden(act, change, ["cell_id", "entity_id"], "activity"), access).select("gate_key_id", "cell_id", F.round("raw", 6).alias("raw"))


@query("x16_perturb_member", "usage members", """WITH lib AS (SELECT cell_id, sum(n) AS library FROM {usage} GROUP BY 1), c AS (SELECT cell_id, gene_id, CASE WHEN gene_id = 'view' THEN n + 5 ELSE n END AS n FROM {usage}),
own AS (SELECT cell_id, entity_id, sum(n) AS raw FROM c u JOIN {members} m ON m.gene_id = u.gene_id GROUP BY 1, 2)
SELECT l.cell_id, e.entity_id, CAST(coalesce(raw, 0) AS BIGINT) AS raw, round(ln(1 + 10000.0 * coalesce(raw, 0) / library), 6) AS activity FROM lib l, (SELECT DISTINCT entity_id FROM {members}) e LEFT JOIN own o ON o.cell_id = l.cell_id AND o.entity_id = e.entity_id""")
def x16(usage, members):
    library = usage.groupBy("cell_id").agg(F.sum("n").alias("library"))
    changed = usage.withColumn("n", F.when(F.col("gene_id") == "view", F.col("n") + 5).otherwise(F.col("n")))
    return cx.entity_activity(changed, members, usage, library).select("cell_id", "entity_id", "raw", F.round("activity", 6).alias("activity"))


@query("x17_perturb_library", "usage members", """WITH c AS (SELECT cell_id, gene_id, CASE WHEN cell_id % 3 = 0 THEN n * 2 + length(gene_id) ELSE n END AS n FROM {usage}), lib AS (SELECT cell_id, sum(n) AS library FROM c GROUP BY 1),
own AS (SELECT cell_id, entity_id, sum(n) AS raw FROM c u JOIN {members} m ON m.gene_id = u.gene_id GROUP BY 1, 2)
SELECT l.cell_id, e.entity_id, round(ln(1 + 10000.0 * coalesce(raw, 0) / library), 6) AS activity FROM lib l, (SELECT DISTINCT entity_id FROM {members}) e LEFT JOIN own o ON o.cell_id = l.cell_id AND o.entity_id = e.entity_id""")
def x17(usage, members):
    changed = usage.withColumn("n", F.when(F.col("cell_id") % 3 == 0, F.col("n") * 2 + F.length("gene_id")).otherwise(F.col("n")))
    return cx.entity_activity(changed, members, usage).select("cell_id", "entity_id", F.round("activity", 6).alias("activity"))


@query("x18_response_curve", "events", """WITH p AS (SELECT DISTINCT user_id AS point_id FROM events), m AS (SELECT DISTINCT event_type AS output_id FROM events WHERE event_type <> 'view'), r AS (SELECT user_id AS point_id, event_type AS output_id, round(avg(value) / 60, 6) AS p FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
w AS (SELECT point_id, output_id, true AS wanted FROM p, m) SELECT coalesce(w.point_id, r.point_id) AS point_id, coalesce(w.output_id, r.output_id) AS output_id, p, CASE WHEN wanted IS NULL THEN 'extra' WHEN p IS NULL THEN 'missing' WHEN p NOT BETWEEN 0 AND 1 THEN 'out_of_bounds' ELSE 'ok' END AS status
FROM w FULL JOIN r ON r.point_id = w.point_id AND r.output_id = w.output_id""")
def x18(events):
    r = events.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("point_id"), F.col("event_type").alias("output_id")).agg(F.round(F.avg("value") / 60, 6).alias("p"))
    return cx.response_curve(events.select(F.col("user_id").alias("point_id")).distinct(), r, events.where("event_type <> 'view'").select(F.col("event_type").alias("output_id")).distinct())


@query("x19_cis_table", "part supplier", """SELECT p_partkey AS edge_id, (p_size % 3 = 0)::INT AS is_splice, (p_size % 3 = 1)::INT AS is_exon, (p_size % 3 = 2)::INT AS is_intron, CASE WHEN p_size % 3 = 0 AND s_suppkey IS NOT NULL THEN s_acctbal ELSE 0 END AS score, p_size % 3 = 0 AND s_suppkey IS NOT NULL AS available FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def x19(part, supplier):
    kind = F.when(F.col("p_size") % 3 == 0, "splice").when(F.col("p_size") % 3 == 1, "exon").otherwise("intron")
    return cx.cis_table(part.select(F.col("p_partkey").alias("edge_id"), kind.alias("kind")), supplier.select(F.col("s_suppkey").alias("edge_id"), F.col("s_acctbal").alias("score")), ["splice", "exon", "intron"])


NORM = """f AS (SELECT p_partkey AS edge_id, 'price' AS feature, p_retailprice AS value, p_size % 2 = 0 AS available, CASE WHEN p_partkey % 5 > 0 THEN 'train' ELSE 'val' END AS split FROM part UNION ALL SELECT p_partkey, 'one', 1.0, true, 'train' FROM part),
n AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS n FROM f WHERE available AND split = 'train' GROUP BY 1)"""


def norm_features(part):
    k = F.col("p_partkey")
    price = part.select(k.alias("edge_id"), F.lit("price").alias("feature"), F.col("p_retailprice").alias("value"), (F.col("p_size") % 2 == 0).alias("available"), F.when(k % 5 > 0, "train").otherwise("val").alias("split"))
    return price.unionByName(part.select(k.alias("edge_id"), F.lit("one").alias("feature"), F.lit(1.0).alias("value"), F.lit(True).alias("available"), F.lit("train").alias("split")))


@query("x20_fit_norm", "part", f"WITH {NORM} SELECT feature, round(mean, 4) AS mean, round(sd, 4) AS sd, n, sd > 0 AS kept FROM n")
def x20(part):
    return cx.fit_norm(norm_features(part)).select("feature", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n", "kept")


@query("x20_apply_norm", "part", f"WITH {NORM} SELECT edge_id, f.feature, round(CASE WHEN available THEN (value - mean) / sd ELSE 0 END, 5) AS z FROM f JOIN n ON n.feature = f.feature WHERE sd > 0")
def x20_apply(part):
    f = norm_features(part)
    return cx.apply_norm(f, cx.fit_norm(f)).withColumn("z", F.round("z", 5))
