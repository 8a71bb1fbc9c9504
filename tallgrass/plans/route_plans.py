"""Queries of routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as ds
from ..operators import routes as rt
from .bindings import BINDINGS, query
from .interval_plans import HOUR, ROUTES, routed

FACTS = """CAST(anchor_id % 7 AS BIGINT) AS edge_id, value AS support, value * 2 AS quality, event_id % 11 AS source_rank, event_id % 3 AS priority,
    CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'calibrated' ELSE 'other' END AS evidence, CASE WHEN user_id % 2 = 0 THEN 'DNA' ELSE 'RNA' END AS modality"""
ROUTE_TABLE = f"SELECT user_id AS gene_id, event_id, anchor_id, route_id, kind, relation, signed_distance, d5, d3, {FACTS} FROM ({ROUTES}) x"
CAP = 4


def route_table(x, regions):
    d = routed(x, regions)
    kinds = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "calibrated").otherwise("other")
    return d.select(
        F.col("user_id").alias("gene_id"), "event_id", "anchor_id", "route_id", "kind", "relation", "signed_distance", "d5", "d3", (F.col("anchor_id") % 7).alias("edge_id"),
        F.col("value").alias("support"), (F.col("value") * 2).alias("quality"), (F.col("event_id") % 11).alias("source_rank"), (F.col("event_id") % 3).alias("priority"),
        kinds.alias("evidence"), F.when(F.col("user_id") % 2 == 0, "DNA").otherwise("RNA").alias("modality"),
    )


BUCKETS = ["gene_id", "modality", "evidence", "edge_id"]
RANKS = f"""t AS ({ROUTE_TABLE}), b AS (SELECT gene_id, modality, evidence, edge_id, event_id, min(CASE WHEN relation = 'OVERLAP_ANCHOR' THEN 0 ELSE coalesce(abs(signed_distance), least(d5, d3)) END) AS near,
 min(support) AS support, min(quality) AS quality, min(source_rank) AS source_rank, min(priority) AS priority FROM t GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, CASE WHEN evidence = 'open' THEN -support WHEN evidence = 'calibrated' THEN -quality ELSE CAST(source_rank AS DOUBLE) END AS k1,
 CASE WHEN evidence = 'calibrated' AND modality = 'DNA' THEN -support WHEN evidence = 'other' THEN CAST(priority AS DOUBLE) ELSE 0 END AS k2 FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY gene_id, modality, evidence, edge_id ORDER BY k1, k2, near, event_id) AS rank FROM k),
c AS (SELECT t.*, rank FROM t JOIN r ON r.gene_id = t.gene_id AND r.modality = t.modality AND r.evidence = t.evidence AND r.edge_id = t.edge_id AND r.event_id = t.event_id WHERE rank <= {CAP})"""


@query("t1_cap_topk", "intervals regions", f"WITH {RANKS} SELECT route_id, event_id, anchor_id, rank FROM c")
def t1(x, regions):
    return rt.cap_topk(route_table(x, regions), CAP, BUCKETS).select("route_id", "event_id", "anchor_id", "rank")


@query("t2_cap_audit", "intervals regions", f"WITH {RANKS} SELECT gene_id, modality, evidence, edge_id, count(*) AS candidates, least(count(*), {CAP}) AS selected, count(*) > {CAP} AS saturated, round(max(k1) FILTER (rank = {CAP}), 6) AS boundary FROM r GROUP BY 1, 2, 3, 4")
def t2(x, regions):
    return rt.cap_audit(route_table(x, regions), CAP, BUCKETS).withColumn("boundary", F.round("boundary", 6))


@query("t3_normalize_routes", "intervals regions", f"WITH {RANKS} SELECT route_id, round(1.0 / count(*) OVER (PARTITION BY event_id), 6) AS weight FROM c")
def t3(x, regions):
    return rt.normalize_routes(rt.cap_topk(route_table(x, regions), CAP, BUCKETS)).select("route_id", F.round("weight", 6).alias("weight"))


@query("t4_finalize_events", "intervals regions", f"""WITH {RANKS}, n AS (SELECT event_id, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'MULTI_ANCHOR' END AS event_kind FROM c GROUP BY 1)
SELECT i.event_id, event_kind, n.event_id IS NOT NULL AS has_route, i.event_id % 4 > 0 AS gate_active, n.event_id IS NOT NULL AND i.event_id % 4 > 0 AS model_active,
concat_ws(',', CASE WHEN n.event_id IS NULL THEN 'no_route' END, CASE WHEN i.event_id % 4 = 0 THEN 'gate_inactive' END) AS reasons FROM {{intervals}} i LEFT JOIN n ON n.event_id = i.event_id""")
def t4(x, regions):
    gates = x.where("event_id % 4 <> 0 OR event_id % 8 = 0").select("event_id", (F.col("event_id") % 4 > 0).alias("gate_active"))
    return rt.finalize_events(x.select("event_id"), rt.cap_topk(route_table(x, regions), CAP, BUCKETS), gates)


@query("t5_degree_cap_audit", "intervals regions", f"""WITH {RANKS}, p AS (SELECT event_id, anchor_id, count(*) AS a_pre FROM t GROUP BY 1, 2), pd AS (SELECT event_id, count(*) AS d_pre FROM t GROUP BY 1), q AS (SELECT event_id, anchor_id, count(*) AS a_post FROM c GROUP BY 1, 2), qd AS (SELECT event_id, count(*) AS d_post FROM c GROUP BY 1)
SELECT p.event_id, p.anchor_id, round(a_pre / CAST(d_pre AS DOUBLE), 6) AS m_pre, round(coalesce(coalesce(a_post, 0) / CAST(d_post AS DOUBLE), 0), 6) AS m_post, round((a_pre - coalesce(a_post, 0)) / CAST(d_pre AS DOUBLE), 6) AS cap_loss
FROM p JOIN pd ON pd.event_id = p.event_id LEFT JOIN q ON q.event_id = p.event_id AND q.anchor_id = p.anchor_id LEFT JOIN qd ON qd.event_id = p.event_id""")
def t5(x, regions):
    r = route_table(x, regions)
    return rt.degree_cap_audit(r, rt.cap_topk(r, CAP, BUCKETS)).select("event_id", "anchor_id", *(F.round(c, 6).alias(c) for c in ("m_pre", "m_post", "cap_loss")))


@query("t6_gate_keys", "events", """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'RNA' WHEN 1 THEN 'OPEN' ELSE 'DNA' END AS m, CAST(user_id AS VARCHAR) AS g, event_type AS n, CAST(event_id % 5 AS VARCHAR) AS p FROM events)
SELECT event_id, 'gate:' || substr(sha256('["' || m || '","' || g || '","' || CASE m WHEN 'RNA' THEN n WHEN 'OPEN' THEN p ELSE n || '","' || p END || '"]'), 1, 24) AS gate_key_id FROM e""")
def t6(events):
    k = F.col("event_id") % 3
    e = events.select("event_id", F.when(k == 0, "RNA").when(k == 1, "OPEN").otherwise("DNA").alias("modality"), F.col("user_id").cast("string").alias("gene_id"), F.col("event_type").alias("entity_id"), (F.col("event_id") % 5).cast("string").alias("peak_id"))
    return rt.event_gate_keys(e).select("event_id", "gate_key_id")


WEIGHTED = f"""{RANKS}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY event_id) AS weight, gene_id AS gate_key_id, event_id % 4 AS col, 1.0 + event_id % 5 AS feature FROM c),
g AS (SELECT DISTINCT user_id AS gate_key_id, user_id % 10 AS cell_id, (user_id % 13 - 6) / 6.0 AS gate FROM {{intervals}})"""


def weighted(x, regions):
    w = rt.normalize_routes(rt.cap_topk(route_table(x, regions), CAP, BUCKETS))
    return w.withColumns({"gate_key_id": F.col("gene_id"), "column": F.col("event_id") % 4, "feature": 1.0 + F.col("event_id") % 5})


def gate_table(x):
    u = F.col("user_id")
    return x.select(u.alias("gate_key_id"), (u % 10).alias("cell_id"), ((u % 13 - 6) / 6.0).alias("gate")).distinct()


@query("t7_gated_aggregate", "intervals regions", f"WITH {WEIGHTED} SELECT cell_id, edge_id, col, round(sum(gate * weight * feature), 6) AS value FROM w JOIN g ON g.gate_key_id = w.gate_key_id GROUP BY 1, 2, 3")
def t7(x, regions):
    return rt.gated_aggregate(weighted(x, regions), gate_table(x)).select("cell_id", "edge_id", F.col("column").alias("col"), F.round("value", 6).alias("value"))


SIGNATURES = f"""WITH {WEIGHTED}, p AS (SELECT gene_id, modality, event_id, edge_id, col, list_reduce(list(weight * CAST(feature AS DOUBLE) ORDER BY route_id), lambda a, b: a + b) AS v FROM w GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT gene_id, modality, event_id, list({{'e': edge_id, 'c': col, 'v': v}} ORDER BY edge_id, col) FILTER (v <> 0) AS sig FROM p GROUP BY 1, 2, 3),
m AS (SELECT event_id, gene_id, modality, min(event_id) OVER (PARTITION BY gene_id, modality, sig) AS representative FROM s),
f AS (SELECT m.*, i.user_id AS chrom, i.s, i.e, event_type AS family, event_type = 'view' AS open FROM m JOIN {{intervals}} i ON i.event_id = m.event_id)"""


def injected(x, regions):
    return rt.injection_signatures(weighted(x, regions))


@query("t8_injection_equivalence", "intervals regions", f"""{SIGNATURES}, cz AS (SELECT DISTINCT a.representative FROM f a JOIN f b ON a.representative = b.representative AND a.family = b.family AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e WHERE NOT a.open)
SELECT gene_id, modality, f.representative, count(*) AS events, CASE WHEN min(s) = max(s) AND min(e) = max(e) THEN 'identical' WHEN max(s) < min(e) THEN 'overlapping' ELSE 'mixed' END AS footprint,
CASE WHEN bool_and(open) THEN 'open_only' WHEN bool_or(open) THEN 'mixed' WHEN min(family) = max(family) THEN 'same' ELSE 'distinct' END AS families, max(cz.representative) IS NOT NULL AS should_have_collapsed,
CASE WHEN count(*) = 1 THEN 'single_event' ELSE 'exact_set' END AS policy FROM f LEFT JOIN cz ON cz.representative = f.representative GROUP BY 1, 2, 3""")
def t8(x, regions):
    events = x.select("event_id", F.col("user_id").alias("chrom"), "s", "e", F.lit("+").alias("strand"), F.lit("").alias("factor"), F.col("event_type").alias("family"), F.lit("").alias("peak"), (F.col("event_type") == "view").alias("open"))
    return rt.injection_equivalence(injected(x, regions), events, strict=False).drop("group_id", "gate_key_id")


@query("t8_injection_members", "intervals regions", f"{SIGNATURES} SELECT event_id, representative FROM m")
def t8_members(x, regions):
    d = injected(x, regions)
    return d.join(d.groupBy("group_id").agg(F.min("event_id").alias("representative")), "group_id").select("event_id", "representative")


@query("t9_resolve_selector", "intervals regions", f"WITH {RANKS} SELECT route_id, event_id FROM c WHERE event_id % 10 = 3")
def t9(x, regions):
    r = rt.cap_topk(route_table(x, regions), CAP, BUCKETS)
    groups = x.select((F.col("event_id") % 10).alias("group_id"), "event_id")
    return rt.selected_routes(r, "group", 3, groups).select("route_id", "event_id")


@query("t9_selector_coverage", "intervals regions", f"""WITH {RANKS}, o AS (SELECT event_id, count(*) AS n FROM c GROUP BY 1), g AS (SELECT DISTINCT user_id * 100 + event_id % 3 AS group_id, event_id FROM {{intervals}})
SELECT group_id, count(*) AS members, count(n) AS routed, CAST(coalesce(sum(n), 0) AS BIGINT) AS routes, CASE WHEN count(n) = 0 THEN 'none' WHEN count(n) < count(*) THEN 'partial' ELSE 'full' END AS coverage FROM g LEFT JOIN o ON o.event_id = g.event_id GROUP BY 1""")
def t9_coverage(x, regions):
    r = rt.cap_topk(route_table(x, regions), CAP, BUCKETS)
    return rt.selector_coverage(r, x.select((F.col("user_id") * 100 + F.col("event_id") % 3).alias("group_id"), "event_id"))


@query("n2_route_bins", "intervals regions", f"""SELECT route_id, event_id, CASE WHEN event_type <> 'view' THEN event_type ELSE 'OPEN_ONLY' END AS factor, CASE WHEN d IS NULL THEN 'NA' WHEN d < {HOUR // 4} THEN '[0,{HOUR // 4})' WHEN d < {HOUR} THEN '[{HOUR // 4},{HOUR})' ELSE '[{HOUR},inf]' END AS bin
FROM (SELECT route_id, event_id, event_type, CASE WHEN kind = 'site' THEN abs(signed_distance) ELSE least(d5, d3) END AS d FROM ({ROUTES}) x) y""")
def n2_bins(x, regions):
    d = F.when(F.col("kind") == "site", F.col("signed_distance")).otherwise(F.least("d5", "d3"))
    routes = routed(x, regions).select("route_id", "event_id", d.alias("distance"))
    events = x.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("factor"))
    return ds.binned_context(events, routes, [0, HOUR // 4, HOUR]).select("route_id", "event_id", "factor", "bin")


@query("t10_neutralize", "intervals regions", f"""WITH {WEIGHTED} SELECT cell_id, edge_id, col, round(sum(gate * weight * feature), 6) AS value, round(-sum(CASE WHEN event_id % 10 = 3 THEN gate * weight * feature ELSE 0 END), 6) AS delta FROM w JOIN g ON g.gate_key_id = w.gate_key_id GROUP BY 1, 2, 3""")
def t10(x, regions):
    w = weighted(x, regions)
    return rt.neutralize(w, gate_table(x), w.where("event_id % 10 = 3")).select("cell_id", "edge_id", F.col("column").alias("col"), F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


BURDEN = """gs AS (SELECT edge_id, gate_key_id, sum(weight) AS w FROM w GROUP BY 1, 2), bg AS (SELECT edge_id, sqrt(sum(w * w)) AS b_gate FROM gs GROUP BY 1),
bu AS (SELECT w.edge_id, count(DISTINCT event_id) AS events, count(DISTINCT gate_key_id) AS gates, count(DISTINCT anchor_id) AS anchors, sum(abs(weight)) AS abs_weight, max(b_gate) AS b_gate FROM w JOIN bg ON bg.edge_id = w.edge_id GROUP BY 1)"""


@query("a13_route_burden", "intervals regions", f"WITH {WEIGHTED}, {BURDEN} SELECT edge_id, events, gates, anchors, round(abs_weight, 6) AS abs_weight, round(b_gate, 6) AS b_gate FROM bu")
def a13(x, regions):
    out = rt.route_burden(weighted(x, regions))
    return out.select("edge_id", "events", "gates", "anchors", F.round("abs_weight", 6).alias("abs_weight"), F.round("b_gate", 6).alias("b_gate"))


@query("a14_burden_by_token", "intervals regions", f"""WITH {WEIGHTED}, {BURDEN}, t2 AS (SELECT e AS edge_id, e % 4 AS token_id FROM range(0, 12) r(e) WHERE e % 4 < 3 OR e > 6)
SELECT token_id, CAST(coalesce(sum(events), 0) AS BIGINT) AS events, round(sqrt(coalesce(sum(b_gate * b_gate), 0)), 6) AS b_gate, CASE WHEN coalesce(sum(events), 0) > 0 THEN 'routed' ELSE 'no_routes_on_token' END AS status FROM t2 LEFT JOIN bu ON bu.edge_id = t2.edge_id GROUP BY 1""")
def a14(x, regions):
    tokens = x.sparkSession.range(12).select(F.col("id").alias("edge_id"), (F.col("id") % 4).alias("token_id")).where("token_id < 3 OR edge_id > 6")
    return rt.burden_by_token(rt.route_burden(weighted(x, regions)), tokens).withColumn("b_gate", F.round("b_gate", 6))


@query("n1_distance_bin", "intervals regions", f"""SELECT route_id, CASE WHEN d IS NULL THEN 'NA' WHEN d < {HOUR // 4} THEN '[0,{HOUR // 4})' WHEN d < {HOUR} THEN '[{HOUR // 4},{HOUR})' ELSE '[{HOUR},inf]' END AS bin
FROM (SELECT route_id, CASE WHEN kind = 'site' THEN abs(signed_distance) ELSE least(d5, d3) END AS d FROM ({ROUTES}) x) y""")
def n1(x, regions):
    d = F.when(F.col("kind") == "site", F.col("signed_distance")).otherwise(F.least("d5", "d3"))
    return routed(x, regions).select("route_id", rt.distance_bin(d, [0, HOUR // 4, HOUR]).alias("bin"))
