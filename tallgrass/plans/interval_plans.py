"""Queries of interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .bindings import BINDINGS, BUILT, lines_of_orders, query

HOUR = 3_600_000_000
BINDINGS |= {
    "regions": f"""SELECT event_id AS anchor_id, user_id, s - {2 * HOUR} AS rs, s + {2 * HOUR} AS re, CASE WHEN event_type = 'view' THEN 'site' ELSE 'edge' END AS kind,
        CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {{intervals}}""",
    "exons": """SELECT o_custkey AS gene_id, o_orderkey AS path_id, l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS s, l_linenumber * 100 + CAST(l_quantity AS BIGINT) + 20 + l_partkey % 60 AS e
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
}


def exons(lineitem, orders):
    at = F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")
    d = lines_of_orders(lineitem, orders)
    return d.select(F.col("o_custkey").alias("gene_id"), F.col("o_orderkey").alias("path_id"), at.alias("s"), (at + 20 + F.col("l_partkey") % 60).alias("e"))


BUILT["exons"] = ("lineitem orders", exons)


@query("i1_oriented_window", "regions", "SELECT anchor_id, CASE WHEN strand = '-' THEN rs - 50 ELSE rs - 10 END AS ws, CASE WHEN strand = '-' THEN rs + 10 ELSE rs + 50 END AS we FROM {regions}")
def i1(regions):
    s, e = iv.oriented_window(F.col("rs"), -10, 50, F.col("strand"))
    return regions.select("anchor_id", s.alias("ws"), e.alias("we"))


@query("i2_overlap_bp", "intervals", f"SELECT event_id, greatest(0, least(e, s - s % {24 * HOUR} + {24 * HOUR}) - greatest(s, s - s % {24 * HOUR} + {12 * HOUR})) AS bp FROM {{intervals}}")
def i2(x):
    day = F.col("s") - F.col("s") % (24 * HOUR)
    return x.select("event_id", iv.overlap_bp(F.col("s"), F.col("e"), day + 12 * HOUR, day + 24 * HOUR).alias("bp"))


ISLANDS = """b AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {intervals}),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before - LEAST THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)"""


@query("i3_merge_intervals", "intervals", f"WITH {ISLANDS.replace('LEAST', '0')} SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS members FROM n GROUP BY user_id, island")
def i3(x):
    return iv.islands(x, ["user_id"])


@query("i3_merge_array", "intervals", f"WITH {ISLANDS.replace('LEAST', '0')}, m AS (SELECT user_id, island, max(e) - min(s) AS span FROM n GROUP BY 1, 2) SELECT user_id, count(*) AS islands, CAST(sum(span) AS BIGINT) AS covered FROM m GROUP BY 1")
def i3_array(x):
    m = x.groupBy("user_id").agg(iv.merge_array(F.collect_list(F.struct("s", "e"))).alias("m"))
    return m.select("user_id", F.size("m").cast("long").alias("islands"), F.aggregate("m", F.lit(0).cast("long"), lambda a, v: a + v.e - v.s).alias("covered"))


@query("i4_subtract", "intervals", f"""WITH p AS (SELECT event_id, s AS a, least(e, s - s % {HOUR} + {HOUR // 2}) AS b FROM {{intervals}} UNION ALL SELECT event_id, greatest(s, s - s % {HOUR} + {HOUR}), e FROM {{intervals}})
SELECT event_id, count(*) AS parts, CAST(sum(b - a) AS BIGINT) AS rest FROM p WHERE a < b GROUP BY 1""")
def i4(x):
    hour = F.col("s") - F.col("s") % HOUR
    out = x.select("event_id", iv.subtract(F.array(F.struct("s", "e")), hour + HOUR // 2, hour + HOUR).alias("p")).where(F.size("p") > 0)
    return out.select("event_id", F.size("p").cast("long").alias("parts"), F.aggregate("p", F.lit(0).cast("long"), lambda a, v: a + v.e - v.s).alias("rest"))


@query("i6_range_join", "intervals regions", "SELECT event_id, anchor_id, i.user_id FROM {intervals} i JOIN {regions} r ON r.user_id = i.user_id AND s < re AND rs < e")
def i6(x, regions):
    out = iv.interval_join(x.select("event_id", "user_id", F.col("s").alias("ls"), F.col("e").alias("le")), regions, ["user_id"], 4 * HOUR)
    return out.select("event_id", "anchor_id", "user_id")


ROUTES = """SELECT event_id, anchor_id, user_id, kind, strand, CASE WHEN kind <> 'site' THEN 'IN_EDGE' WHEN inside THEN 'OVERLAP_ANCHOR' WHEN (c - m) * sign < 0 THEN 'UPSTREAM' ELSE 'DOWNSTREAM' END AS relation,
CASE WHEN kind = 'site' AND NOT inside THEN (c - m) * sign END AS signed_distance, CASE WHEN kind = 'edge' THEN CASE WHEN strand = '-' THEN re - 1 - c ELSE c - rs END END AS d5,
CASE WHEN kind = 'edge' THEN re - rs - 1 - CASE WHEN strand = '-' THEN re - 1 - c ELSE c - rs END END AS d3, 'route:' || substr(sha256(event_id || '|' || anchor_id), 1, 24) AS route_id, event_type, value
FROM (SELECT i.event_id, i.event_type, i.value, r.anchor_id, i.user_id, kind, strand, rs, re, CAST(floor((s + e) / 2) AS BIGINT) AS c, CAST(floor((rs + re) / 2) AS BIGINT) AS m, s >= rs AND e <= re AS inside, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS sign
FROM {intervals} i JOIN {regions} r ON r.user_id = i.user_id AND s < re AND rs < e) x WHERE kind = 'site' OR (c >= rs AND c < re)"""


def routed(x, regions):
    left = x.select("event_id", "user_id", "event_type", "value", F.col("s").alias("ls"), F.col("e").alias("le"))
    return iv.route_events(left, regions, ["user_id"], 4 * HOUR)


COLUMNS = ["event_id", "anchor_id", "relation", "signed_distance", "d5", "d3", "route_id"]


@query("i7_route_events", "intervals regions", f"SELECT {', '.join(COLUMNS)} FROM ({ROUTES}) x")
def i7(x, regions):
    return routed(x, regions).select(*COLUMNS)


@query("i8_unique_owner", "lineitem", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_extendedprice DESC, l_suppkey, l_orderkey, l_linenumber) AS k FROM lineitem),
p AS (SELECT l_partkey, l_quantity, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS peaks, count(*) AS n_hits FROM lineitem GROUP BY 1, 2)
SELECT r.l_partkey, r.l_quantity, l_suppkey, peaks, n_hits FROM r JOIN p ON p.l_partkey = r.l_partkey AND p.l_quantity = r.l_quantity WHERE k = 1""")
def i8(lineitem):
    h = lineitem.select("l_partkey", "l_quantity", "l_suppkey", F.col("l_suppkey").cast("string").alias("peak_id"), F.col("l_extendedprice").alias("support"), F.struct("l_orderkey", "l_linenumber").alias("hit_id"))
    h = h.withColumn("hit_id", F.struct(F.col("l_suppkey"), "hit_id"))
    peaks = iv.unique_owner(h.withColumn("peak_id", F.lpad("peak_id", 12, "0")), ["l_partkey", "l_quantity"])
    text = h.groupBy("l_partkey", "l_quantity").agg(F.array_join(F.array_sort(F.collect_set("peak_id")), ",").alias("texts"))
    return peaks.join(text, ["l_partkey", "l_quantity"]).select("l_partkey", "l_quantity", "l_suppkey", F.col("texts").alias("peaks"), "n_hits")


@query("i9_collapse_overlaps", "intervals", f"""WITH {ISLANDS.replace('LEAST', '1')}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY value DESC, event_id) AS k FROM n)
SELECT user_id, min(s) AS from_s, max(e) AS to_e, count(*) AS n_hits, min(event_id) FILTER (k = 1) AS representative FROM k GROUP BY user_id, island""")
def i9(x):
    return iv.collapse_overlaps(x.withColumnsRenamed({"event_id": "hit_id", "value": "quality"}), ["user_id"])


def i9_sql(least: int, share: float, rest: str) -> str:
    """All pairs of a bucket, components by recursion, and the representative's rule."""
    return f"""WITH RECURSIVE h AS (SELECT event_id AS hit_id, user_id, s, e, CASE WHEN event_id % 3 > 0 THEN value END AS quality, event_id % 7 AS local_rank, event_id % 2 AS priority, event_type AS motif_id, value > 1 AS valid FROM {{intervals}}),
l AS (SELECT x.hit_id AS a, y.hit_id AS b FROM h x JOIN h y ON x.user_id = y.user_id AND x.hit_id <> y.hit_id AND x.s < y.e AND y.s < x.e WHERE least(x.e, y.e) - greatest(x.s, y.s) >= {least}
  AND (least(x.e, y.e) - greatest(x.s, y.s)) / CAST(greatest(x.e - x.s, y.e - y.s) AS DOUBLE) >= {share}),
r AS (SELECT hit_id, hit_id AS root FROM h UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.hit_id),
m AS (SELECT h.*, c.component FROM h JOIN (SELECT hit_id, min(root) AS component FROM r GROUP BY 1) c ON c.hit_id = h.hit_id),
b AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY quality IS NULL, -quality, CASE WHEN quality IS NULL THEN local_rank END, priority, s, e, motif_id, hit_id) AS k FROM m),
v AS (SELECT component, min(s) AS from_s, max(e) AS to_e, count(*) AS n_hits, count(DISTINCT motif_id) AS n_motifs, bool_and(valid) AS valid FROM m GROUP BY 1),
w AS (SELECT 'event:' || substr(sha256(concat_ws('|', user_id, s, e)), 1, 24) AS event_id, user_id, hit_id AS representative, s, e, motif_id, from_s, to_e, n_hits, n_motifs, v.valid, v.component FROM b JOIN v ON v.component = b.component WHERE k = 1)
{rest}"""


def i9_hits(x):
    quality = F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("quality")
    return x.select(F.col("event_id").alias("hit_id"), "user_id", "s", "e", quality, (F.col("event_id") % 7).alias("local_rank"), (F.col("event_id") % 2).alias("priority"), F.col("event_type").alias("motif_id"), (F.col("value") > 1).alias("valid"))


@query("i9_collapse_share", "intervals", i9_sql(5, 0.5, "SELECT event_id, user_id, representative, s, e, motif_id, from_s, to_e, n_hits, n_motifs, valid FROM w"))
def i9_share(x):
    return iv.collapse_hits(iv.collapse_members(i9_hits(x), ["user_id"], 5, 0.5), ["user_id"]).drop("component")


@query("i9_provenance", "intervals", i9_sql(20 * HOUR // 60, 0.0, "SELECT w.event_id, m.hit_id, m.s, m.e FROM m JOIN w ON w.component = m.component"))
def i9_provenance(x):
    """The hits of every event that overlaps by twenty minutes make."""
    members = iv.collapse_members(i9_hits(x), ["user_id"], 20 * HOUR // 60)
    return members.join(iv.collapse_hits(members, ["user_id"]).select("event_id", "component"), "component").select("event_id", "hit_id", "s", "e")


@query("i10_open_hits", "intervals", f"SELECT user_id, event_type, s - s % {24 * HOUR} AS day, count(*) AS n_peaks, max(value) AS support, min(event_id) AS peak_id FROM {{intervals}} GROUP BY 1, 2, 3")
def i10(x):
    day = (F.col("s") - F.col("s") % (24 * HOUR)).alias("day")
    return iv.open_hits(x.select("user_id", "event_type", day, F.col("value").alias("support"), F.col("event_id").alias("peak_id")), ["user_id", "event_type", "day"])


@query("i11_scan_pwm", "documents")
def i11(documents):
    seq = F.upper(F.regexp_replace("text", "[^acgtACGT]", "N"))
    pwm = {"m1": [[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.7], [0.25, 0.25, 0.25, 0.25]], "m2": [[0.9, 0.03, 0.04, 0.03], [0.1, 0.4, 0.4, 0.1]]}
    out = iv.scan_pwm(documents.select(F.col("doc_id").alias("seq_id"), seq.alias("sequence")), pwm, 0.75)
    return out.withColumn("score", F.round("score", 6))


@query("i12_local_rank", "intervals", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS local_rank FROM {intervals}")
def i12(x):
    return iv.local_rank(x.withColumnsRenamed({"event_id": "hit_id", "value": "score"}), ["user_id", "event_type"]).select(F.col("hit_id").alias("event_id"), "local_rank")


@query("i13_sequence_scores", "documents", """WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^acgtACGT]', 'N', 'g')) AS q FROM documents),
w AS (SELECT doc_id, CASE WHEN length(q) < 3 THEN 0 WHEN regexp_matches(q, 'T[AG][ACGT]') THEN 3 WHEN regexp_matches(q, 'T[AG].|T.[ACGT]|.[AG][ACGT]') THEN 2 WHEN regexp_matches(q, 'T..|.[AG].|..[ACGT]') THEN 1 ELSE 0 END / 3.0 AS tra FROM s)
SELECT s.doc_id, round((length(q) - length(replace(q, 'A', ''))) / CAST(nullif(length(replace(q, 'N', '')), 0) AS DOUBLE), 6) AS frac_a, round((length(q) - length(replace(q, 'G', ''))) / CAST(nullif(length(replace(q, 'N', '')), 0) AS DOUBLE), 6) AS frac_g, round(coalesce(tra, 0), 6) AS best
FROM s LEFT JOIN w ON w.doc_id = s.doc_id""")
def i13(documents):
    d = documents.select("doc_id", F.upper(F.regexp_replace("text", "[^acgtACGT]", "N")).alias("q"))
    f = iv.base_fractions(F.col("q"))
    return d.select("doc_id", F.round(f["A"], 6).alias("frac_a"), F.round(f["G"], 6).alias("frac_g"), F.round(iv.consensus_fraction(F.col("q"), "TRN"), 6).alias("best"))


@query("i14_event_kind", "intervals regions", f"SELECT event_id, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'MULTI_ANCHOR' END AS event_kind FROM ({ROUTES}) x GROUP BY 1")
def i14(x, regions):
    return iv.event_kind(routed(x, regions))


PATHS = """d AS (SELECT gene_id, path_id, s, max(e) AS e FROM {exons} GROUP BY 1, 2, 3), o AS (SELECT *, lag(e) OVER (PARTITION BY gene_id, path_id ORDER BY s) AS pe FROM d), x AS (SELECT gene_id, path_id, s, e FROM o)"""


def exon_paths(exons):
    d = exons.groupBy("gene_id", "path_id", "s").agg(F.max("e").alias("e"))
    return d.groupBy("gene_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"))


@query("g1_introns", "exons", f"WITH {PATHS} SELECT gene_id, path_id, pe AS s, s AS e FROM o WHERE pe IS NOT NULL")
def g1(exons):
    return exon_paths(exons).select("gene_id", "path_id", F.explode(iv.introns(F.col("exons"))).alias("j")).select("gene_id", "path_id", "j.s", "j.e")


@query("g3_retained_introns", "exons", f"""WITH {PATHS}, j AS (SELECT gene_id, pe AS s, s AS e, string_agg(DISTINCT CAST(path_id AS VARCHAR), ',' ORDER BY CAST(path_id AS VARCHAR)) AS spliced_by FROM o WHERE pe IS NOT NULL GROUP BY 1, 2, 3)
SELECT j.gene_id, j.s, j.e, spliced_by, string_agg(DISTINCT CAST(x.path_id AS VARCHAR), ',' ORDER BY CAST(x.path_id AS VARCHAR)) AS retained_by FROM j JOIN x ON x.gene_id = j.gene_id AND x.s <= j.s AND x.e >= j.e GROUP BY 1, 2, 3, 4""")
def g3(exons):
    out = iv.retained_intron_opportunities(exon_paths(exons.withColumn("path_id", F.col("path_id").cast("string"))))
    return out.select("gene_id", "s", "e", F.array_join("spliced_by", ",").alias("spliced_by"), F.array_join("retained_by", ",").alias("retained_by"))
