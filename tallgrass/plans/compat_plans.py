"""Queries of read compatibility and design."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compat as cp
from ..operators import design as ds
from ..operators import regress
from ..streaming.components import correlated_sets
from .bindings import BINDINGS, query
from .interval_plans import exon_paths

BINDINGS |= {
    "reads": """SELECT o_custkey AS gene_id, l_orderkey AS read_id, l_linenumber AS k, l_linenumber * 100 + l_partkey % 7 AS start, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) % 17 + 1 AS b, CAST(l_quantity AS BIGINT) % 13 + 1 AS c,
        l_returnflag AS flag, l_suppkey % 60 AS mapq FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "context": """SELECT event_id, event_id AS route_id, user_id % 12 AS gene_id, CASE WHEN event_type <> 'view' THEN 'f' || user_id % 5 END AS factor, event_type AS kind, event_id % 3 AS zone, value FROM {events}""",
}


def cigar():
    """Three shapes: plain, with insertions beside matches, and with an insertion right behind a junction."""
    plain = F.format_string("3S%dM%dN%dM2D%dM", "a", "b", "c", "b")
    inserted = F.format_string("3S%dM2I%dM%dN%d=1I%dM2D%dM4H", "a", "c", "b", "b", "c", "b")
    behind = F.format_string("2H%dM%dN1I%dX%dN%dM1P%d=", "a", "b", "c", "b", "b", "c")
    return F.when(F.col("k") % 3 == 0, plain).when(F.col("k") % 3 == 1, inserted).otherwise(behind)


def said(*parts):
    """SQL of numbers and quoted signs, put end to end."""
    return " || ".join(p if p.startswith("'") else f"({p})" for p in parts)


def shapes(plain, inserted, behind):
    return f"CASE WHEN k % 3 = 0 THEN {plain} WHEN k % 3 = 1 THEN {inserted} ELSE {behind} END"


def boxes(*ends):
    return said(*(x for s, e in ends for x in ("'['", s, "','", e, "']'")))


JUNCTION = ("'('", "{s}", "','", "{s} + b", "'|'", "{l}", "','", "{r}", "')'")
joint = lambda s, l, r: said(*(x.format(s=s, l=l, r=r) for x in JUNCTION))  # noqa: E731, E741
BLOCKS = shapes(
    boxes(("start", "start + a"), ("start + a + b", "start + a + b + c"), ("start + a + b + c + 2", "start + a + b + c + 2 + b")),
    boxes(("start", "start + a + c"), ("start + a + c + b", "start + a + 2 * c + 2 * b"), ("start + a + 2 * c + 2 * b + 2", "start + a + 2 * c + 3 * b + 2")),
    boxes(("start", "start + a"), ("start + a + b", "start + a + b + c"), ("start + a + 2 * b + c", "start + a + 3 * b + 2 * c")),
)
JUNCTIONS = shapes(joint("start + a", "a", "c"), joint("start + a + c", "c", "b"), joint("start + a", "a", "0") + " || " + joint("start + a + b + c", "c", "b"))
DELETIONS = shapes(boxes(("start + a + b + c", "start + a + b + c + 2")), boxes(("start + a + 2 * c + 2 * b", "start + a + 2 * c + 2 * b + 2")), "''")


@query("c1_expand_cigar", "reads", f"""SELECT read_id, k, start, a, {BLOCKS} AS blocks, {JUNCTIONS} AS junctions, {DELETIONS} AS deletions, CAST({shapes('3', '7', '2')} AS BIGINT) AS clipped FROM {{reads}}""")
def c1(reads):
    d = reads.withColumn("x", cp.expand_cigar(cigar(), F.col("start")))
    iv = lambda c: F.array_join(F.transform(c, lambda v: F.concat(F.lit("["), v.s, F.lit(","), v.e, F.lit("]"))), "")
    j = F.array_join(F.transform("x.junctions", lambda v: F.concat(F.lit("("), v.s, F.lit(","), v.e, F.lit("|"), v.left, F.lit(","), v.right, F.lit(")"))), "")
    return d.select("read_id", "k", "start", "a", iv(F.col("x.blocks")).alias("blocks"), j.alias("junctions"), iv(F.col("x.deletions")).alias("deletions"), F.col("x.clipped").alias("clipped"))


NAMES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'bad' || c_custkey ELSE repeat('ACGT', 4) || '_' || repeat('TTG', 4) || '#' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '_' || CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END END AS name FROM customer"


@query("c2_parse_read_name", "customer", f"""SELECT id, CASE WHEN name LIKE 'bad%' THEN NULL ELSE substr(name, 1, 16) END AS barcode, CASE WHEN name LIKE 'bad%' THEN NULL ELSE substr(name, 18, 12) END AS umi, CASE WHEN name LIKE 'bad%' THEN NULL ELSE right(name, 1) END AS strand,
CASE WHEN name LIKE 'bad%' THEN 'unparsed_read_name' END AS reason FROM ({NAMES}) x""")
def c2(customer):
    k = F.col("c_custkey")
    good = F.concat(F.expr("repeat('ACGT', 4)"), F.lit("_"), F.expr("repeat('TTG', 4)"), F.lit("#"), F.lpad(k.cast("string"), 8, "0"), F.lit("_"), F.when(k % 2 == 0, "+").otherwise("-"))
    d = customer.select(k.alias("id"), cp.parse_read_name(F.when(k % 5 == 0, F.concat(F.lit("bad"), k)).otherwise(good)).alias("r"))
    return d.select("id", "r.barcode", "r.umi", "r.strand", "r.reason")


@query("c3_qc_reasons", "reads", f"""SELECT read_id, k, start, a, concat_ws(',', CASE WHEN b > 9 AND a % 2 = 0 THEN NULL END, CASE WHEN mapq < 10 THEN 'mapq_below_minimum' END, CASE WHEN flag = 'R' THEN 'not_primary' END, CASE WHEN {shapes('least(a, c)', 'least(b, c)', '0')} < 8 THEN 'short_anchor' END, CASE WHEN a % 2 = 1 THEN 'strand_conflict' END) AS reasons FROM {{reads}}""")
def c3(reads):
    x = cp.expand_cigar(cigar(), F.col("start"))
    d = reads.withColumn("x", x)
    why = cp.qc_reasons(F.col("flag") != "R", F.lit(True), F.col("mapq"), F.lit(False), F.col("a") % 2 == 0, d["x"], 10, 8, 5)
    return d.select("read_id", "k", "start", "a", F.array_join(why, ",").alias("reasons"))


def evidence(reads):
    return reads.withColumn("x", cp.expand_cigar(F.format_string("%dM", F.col("a") + 40), F.col("start")))


def opportunities():
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i * 100 + 60).cast("bigint").alias("s"), (i * 100 + 75).cast("bigint").alias("e")))


@query("c4_ir_evidence", "reads", """WITH o AS (SELECT i * 100 + 60 AS s, i * 100 + 75 AS e FROM range(0, 8) r(i)) SELECT read_id, k, start, a, count(*) FILTER (start <= s - 5 AND start + a + 40 >= e + 5) AS supported, count(*) FILTER (NOT (start <= s - 5 AND start + a + 40 >= e + 5) AND start < e AND s < start + a + 40) AS censored
FROM (SELECT row_number() OVER () AS id, * FROM {reads}) r, o GROUP BY id, 1, 2, 3, 4""")
def c4(reads):
    d = evidence(reads).withColumn("r", cp.ir_evidence(F.col("x.blocks"), F.col("x.junctions"), opportunities(), 2, 5))
    return d.select("read_id", "k", "start", "a", F.size("r.supported").cast("long").alias("supported"), F.size("r.censored").cast("long").alias("censored"))


@query("c5_compatible_paths", "reads exons", """WITH d AS (SELECT gene_id, path_id, s, max(e) AS e FROM {exons} GROUP BY 1, 2, 3), r AS (SELECT gene_id, read_id, k, start, a, start AS bs, start + 15 AS be FROM {reads})
SELECT r.gene_id, read_id, k, start, a, coalesce(string_agg(DISTINCT CAST(d.path_id AS VARCHAR), ',' ORDER BY CAST(d.path_id AS VARCHAR)), '') AS compatible FROM (SELECT row_number() OVER () AS id, * FROM r) r LEFT JOIN d ON d.gene_id = r.gene_id AND bs >= s - 3 AND be <= e + 3 GROUP BY id, 1, 2, 3, 4, 5""")
def c5(reads, exons):
    d = reads.withColumn("x", cp.expand_cigar(F.lit("15M"), F.col("start"))).select("gene_id", "read_id", "k", "start", "a", "x.blocks", "x.junctions", F.array().cast(cp.IV).alias("censored"))
    out = cp.compatible_paths(d, exon_paths(exons.withColumn("path_id", F.col("path_id").cast("string"))), 3)
    return out.select("gene_id", "read_id", "k", "start", "a", F.array_join("compatible", ",").alias("compatible"))


@query("c7_assign_gene_cell", "lineitem part cells", """SELECT CASE WHEN p_partkey IS NULL THEN 'unknown_transcript' WHEN cell_id IS NULL THEN 'unknown_cell' WHEN cell_id % 10 = 9 THEN 'test_cell' END AS unresolved, count(*) AS rows
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 > 0) p ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM {cells} WHERE cell_id % 5 > 0) c ON cell_id = l_suppkey GROUP BY 1""")
def c7(lineitem, part, cells):
    a = lineitem.select(F.col("l_partkey").alias("tx_id"), F.lit("d").alias("donor_id"), F.lit("l").alias("library_id"), F.col("l_suppkey").alias("barcode"))
    c = cells.where("cell_id % 5 > 0").select(F.lit("d").alias("donor_id"), F.lit("l").alias("library_id"), F.col("cell_id").alias("barcode"), "cell_id", F.when(F.col("cell_id") % 10 == 9, "test").otherwise("train").alias("split"))
    return cp.assign_gene_cell(a, part.where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("tx_id"), F.col("p_brand").alias("gene_id")), c)[1]


@query("c11_retained_intron_class", "reads", """SELECT read_id, k, start, a, CASE WHEN flag = 'R' THEN 'qc_fail' WHEN l AND r THEN 'bilateral' WHEN l OR r THEN 'single_boundary' WHEN start >= 100 * k + 20 AND start + a <= 100 * k + 35 THEN 'intron_only' ELSE 'not_covering' END AS ir_class
FROM (SELECT *, start <= 100 * k + 20 - 4 AND start + a > 100 * k + 20 AS l, start + a >= 100 * k + 35 + 4 AND start < 100 * k + 35 AS r FROM {reads}) x""")
def c11(reads):
    d = reads.select("read_id", "k", "start", "a", F.col("start").alias("s"), (F.col("start") + F.col("a")).alias("e"), (100 * F.col("k") + 20).alias("is_"), (100 * F.col("k") + 35).alias("ie"), (F.col("flag") != "R").alias("qc_pass"))
    return cp.classify_retained_intron(d, 4).select("read_id", "k", "start", "a", "ir_class")


@query("c11_intron_evidence", "reads", """WITH m AS (SELECT DISTINCT read_id || '|' || k || '|' || start || '|' || a || '|' || flag AS molecule_id, k AS intron_id, flag, start AS s, start + a AS e, 100 * k + 20 AS i, 100 * k + 35 AS j, a FROM {reads}),
b AS (SELECT *, greatest(0, least(e, i) - s) AS le, greatest(0, least(e, i + 8) - greatest(s, i)) AS li, greatest(0, least(e, j) - greatest(s, j - 7)) AS ri, greatest(0, e - greatest(s, j)) AS re, flag <> 'R' AS qc, a % 5 = 0 AS excising, a % 3 = 0 AS spliced, a % 7 = 0 AS mature FROM m),
v AS (SELECT *, qc AND le >= 4 AND li >= 3 AS l, qc AND re >= 4 AND ri >= 3 AS r FROM b), n AS (SELECT *, CASE WHEN NOT qc THEN 'qc_failure' WHEN excising THEN 'excising_junction' WHEN l AND r THEN 'bilateral' WHEN l OR r THEN 'single_boundary' WHEN li > 0 OR ri > 0 THEN 'intron_only' ELSE 'no_boundary' END AS evidence FROM v)
SELECT molecule_id, intron_id, evidence, evidence = 'bilateral' AS supported, qc AND evidence <> 'bilateral' AS censored, CASE WHEN spliced THEN 'processed_context' ELSE 'mature_or_nascent' END AS biogenesis, CASE WHEN evidence <> 'bilateral' THEN 'not_retained' WHEN mature THEN 'mature_by_protocol' WHEN spliced THEN 'processed_context' ELSE 'mature_or_nascent' END AS scope FROM n""")
def c11_evidence(reads):
    s, e, i, j = F.col("start"), F.col("start") + F.col("a"), 100 * F.col("k") + 20, 100 * F.col("k") + 35
    d = reads.select(
        F.concat_ws("|", *(F.col(c).cast("string") for c in ("read_id", "k", "start", "a", "flag"))).alias("molecule_id"), F.col("k").alias("intron_id"), (F.col("flag") != "R").alias("is_primary"), F.lit(False).alias("is_chimeric"), F.lit(60).alias("mapq"),
        F.greatest(F.lit(0), F.least(e, i) - s).alias("left_exon"), F.greatest(F.lit(0), F.least(e, i + 8) - F.greatest(s, i)).alias("left_intron"),
        F.greatest(F.lit(0), F.least(e, j) - F.greatest(s, j - 7)).alias("right_intron"), F.greatest(F.lit(0), e - F.greatest(s, j)).alias("right_exon"),
        (F.col("a") % 5 == 0).alias("excising"), F.when(F.col("a") % 3 == 0, 1).otherwise(0).alias("other_junctions"), F.lit(1).alias("unspliced_introns"), (F.col("a") % 7 == 0).alias("mature"),
    )
    return cp.intron_evidence(d.distinct(), 20, 4, 3).select("molecule_id", "intron_id", "evidence", "supported", "censored", "biogenesis", "scope")


@query("c12_rebuild_after_ir", "ec axis", """SELECT cell_id, e.gene_id, CASE WHEN mass % 2 = 0 THEN 'full' WHEN len(string_split(paths_key, ';')) = n_legal THEN 'full' ELSE 'informative' END AS fate, CASE WHEN mass % 2 = 0 THEN axis_key ELSE paths_key END AS paths FROM {ec} e JOIN {axis} a ON a.gene_id = e.gene_id""")
def c12(ec, axis):
    legal = F.split("axis_key", ";")
    own = F.split("paths_key", ";")
    d = ec.join(axis, "gene_id").withColumns({"legal": legal, "non_ir": own, "ir": F.array_except(legal, own), "supported": F.col("mass") % 2 == 0})
    return cp.rebuild_after_ir(d).select("cell_id", "gene_id", "fate", F.array_join("paths", ";").alias("paths"))


@query("n2_route_context", "context", "SELECT event_id, route_id, coalesce(factor, 'OPEN_ONLY') AS factor FROM {context}")
def n2(context):
    return ds.route_context(context.select("event_id", "factor"), context.select("event_id", "route_id")).select("event_id", "route_id", "factor")


@query("n3_feature_manifest", "context", """WITH l AS (SELECT 'kind' AS field, kind AS level FROM {context} UNION ALL SELECT 'zone', CAST(zone AS VARCHAR) FROM {context} UNION ALL SELECT 'factor', factor FROM {context})
SELECT field, string_agg(DISTINCT level, ',' ORDER BY level) AS levels, min(level) AS reference, CAST(count(DISTINCT level) AS INTEGER) AS n_levels FROM l WHERE level IS NOT NULL GROUP BY 1""")
def n3(context):
    return ds.feature_manifest(context, ["kind", "zone", "factor"]).withColumn("levels", F.array_join("levels", ","))


DESIGN = """x AS (SELECT route_id, 'factor=' || factor AS col, 1.0::DOUBLE AS value FROM {context} WHERE factor IS NOT NULL UNION ALL SELECT route_id, 'zone=' || zone, 1.0 FROM {context} WHERE zone > 0 UNION ALL SELECT route_id, 'value', ln(1 + abs(value)) FROM {context} WHERE value <> 0)"""


def design(context):
    c = context.select("route_id", "factor", "zone", "value")
    return ds.encode_base(c, ds.feature_manifest(c, ["factor", "zone"]), ["factor", "zone"], ["value"], "factor")


@query("n4_encode_base", "context", f"WITH {DESIGN} SELECT route_id, col, round(value, 6) AS value FROM x")
def n4(context):
    return design(context).select("route_id", F.col("column").alias("col"), F.round("value", 6).alias("value"))


@query("n5_gram", "context", f"WITH {DESIGN} SELECT a.col AS c1, b.col AS c2, round(sum(a.value * b.value), 3) AS value FROM x a JOIN x b ON a.route_id = b.route_id AND a.col <= b.col GROUP BY 1, 2")
def n5(context):
    return ds.gram(design(context)).withColumn("value", F.round("value", 3))


@query("n6_rank_closure", "context")
def n6(context):
    d = design(context)
    twin = d.where(F.col("column") == "zone=1").withColumn("column", F.lit("zone_again"))
    d = d.unionByName(twin)
    names = [r.column for r in d.select("column").distinct().limit(regress.MOST_COLUMNS + 1).collect()]
    return regress.closed_columns(d, sorted(names), {n for n in names if n.startswith("factor=")})


LONG = """l AS (SELECT event_id, gene_id, coalesce(factor, 'OPEN_ONLY') AS factor, 'kind' AS field, kind AS level FROM {context} UNION ALL SELECT event_id, gene_id, coalesce(factor, 'OPEN_ONLY'), 'zone', CAST(zone AS VARCHAR) FROM {context}),
g AS (SELECT factor, field, level FROM (SELECT DISTINCT factor FROM l) a, (SELECT DISTINCT field, level FROM l) b), e AS (SELECT field, factor, level, count(DISTINCT event_id) AS events, count(DISTINCT gene_id) AS genes FROM l GROUP BY 1, 2, 3),
m AS (SELECT field, factor, level, sum(gene_id * 10) AS mass FROM (SELECT DISTINCT field, factor, level, gene_id FROM l) y GROUP BY 1, 2, 3),
s AS (SELECT g.field, g.factor, g.level, coalesce(events, 0) AS events, coalesce(genes, 0) AS genes, CAST(coalesce(mass, 0) AS BIGINT) AS mass, coalesce(events, 0) >= 300 AND coalesce(mass, 0) >= 50 AS supported FROM g LEFT JOIN e ON e.field = g.field AND e.factor = g.factor AND e.level = g.level LEFT JOIN m ON m.field = g.field AND m.factor = g.factor AND m.level = g.level)"""


def support(context):
    c = context.withColumn("factor", F.coalesce("factor", F.lit("OPEN_ONLY")))
    mass = c.select("gene_id", (F.col("gene_id") * 10).alias("mass")).distinct()
    return ds.interaction_support(c, ["kind", "zone"], mass, 300, 50)


@query("n7_interaction_support", "context", f"WITH {LONG} SELECT * FROM s")
def n7(context):
    return support(context)


@query("n8_supported_rectangles", "context", f"""WITH {LONG}, t AS (SELECT * FROM s WHERE supported) SELECT a.field, a.factor, b.factor AS factor2, a.level, c.level AS level2 FROM t a JOIN t b ON a.field = b.field AND a.level = b.level AND a.factor < b.factor
JOIN t c ON c.field = a.field AND c.factor = a.factor AND c.level > a.level JOIN t d ON d.field = a.field AND d.factor = b.factor AND d.level = c.level""")
def n8(context):
    return ds.supported_rectangles(support(context))


@query("n9_cycle_space", "context")
def n9(context):
    return ds.cycle_space_dim(support(context))


@query("n10_interaction_claims", "context", f"""WITH {LONG}, p AS (SELECT a.field, a.factor, a.level, b.level AS level2, a.supported AND b.supported AS ok FROM s a JOIN s b ON a.field = b.field AND a.factor = b.factor AND a.level < b.level),
q AS (SELECT p.*, (SELECT count(*) FROM p o WHERE o.field = p.field AND o.level = p.level AND o.level2 = p.level2 AND o.factor <> p.factor AND o.ok) AS k FROM p)
SELECT field, factor, level, level2, CASE WHEN ok THEN k ELSE 0 END AS comparators, CASE WHEN NOT ok THEN 'unsupported_arm' WHEN k = 0 THEN 'within_factor_only' ELSE 'four_corner_covered' END AS status FROM q""")
def n10(context):
    return ds.interaction_claims(support(context))


@query("x14_correlated_sets", "lineitem")
def x14(lineitem):
    p = lineitem.select(F.concat(F.lit("p"), "l_partkey").alias("gate_a"), F.concat(F.lit("s"), F.col("l_suppkey") * 100 + F.col("l_orderkey") % 97).alias("gate_b"))
    return correlated_sets(p)
