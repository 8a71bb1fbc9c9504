"""Queries of graphs and identifiability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import identify as idf
from .bindings import BINDINGS, query
from .interval_plans import exon_paths

BINDINGS |= {
    "steps": """SELECT conv_id % 40 AS gene_id, conv_id AS path_id, turn AS edge_order, role AS src, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'end') AS dst,
        role || '>' || coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), 'end') || turn AS edge_id FROM {conversations}""",
    "patterns": "SELECT gene_id, paths_key, CAST(sum(mass) AS BIGINT) AS mass, count(*) AS row_count FROM {ec_fates} WHERE split = 'train' AND fate = 'informative' GROUP BY 1, 2",
    "alternatives": "SELECT gene_id, library_id AS choice_id, donor_id || qc_pass AS alternative_id, CAST(sum(n) AS BIGINT) - 3000 AS mass FROM {molecules} GROUP BY 1, 2, 3",
}


@query("g2_compile_graph", "exons", None)
def g2(exons):
    paths = exon_paths(exons).withColumn("strand", F.when(F.col("gene_id") % 20 == 0, "-").otherwise("+"))
    _, edges, steps = gr.compile_graph(paths)
    n = steps.groupBy("gene_id").agg(F.count_distinct("path_id").alias("paths"), F.count("*").alias("steps"))
    return edges.groupBy("gene_id").agg(F.count("*").alias("edges"), F.count_if(F.col("edge_type") == "SPLICE").alias("splices"), F.count_if(F.col("edge_type") == "RETAINED_INTRON").alias("retained"), F.sum("length_bp").alias("length_bp")).join(n, "gene_id")


@query("g4_validate_paths", "steps", """SELECT gene_id, path_id, 'repeated_edge' AS violation, CAST(sum(k) AS BIGINT) AS rows FROM (SELECT gene_id, path_id, src, dst, count(*) AS k FROM {steps} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) x GROUP BY 1, 2""")
def g4(steps):
    return gr.validate_paths(steps)


@query("g4_validate_graph", "steps", """WITH p AS (SELECT gene_id, path_id, count(*) + CASE WHEN path_id % 50 = 0 THEN 1 ELSE 0 END AS n_edges, arg_min(src, edge_order) AS a, arg_max(dst, edge_order) AS z, 'user' AS start, 'end' AS stop FROM {steps} GROUP BY 1, 2), n AS (SELECT 'user' AS node, 1 AS pos UNION ALL SELECT 'assistant', 2 UNION ALL SELECT 'end', 3),
v AS (SELECT gene_id, path_id, 'n_edges_differ' AS violation, 1 AS rows FROM p WHERE path_id % 50 = 0 UNION ALL SELECT gene_id, path_id, 'wrong_start', 1 FROM p WHERE a <> 'user' UNION ALL SELECT gene_id, path_id, 'wrong_end', 1 FROM p WHERE z <> 'end'
UNION ALL SELECT gene_id, path_id, 'unknown_node', count(*) FROM steps_ LEFT JOIN n a ON a.node = src LEFT JOIN n b ON b.node = dst WHERE a.pos IS NULL OR b.pos IS NULL GROUP BY 1, 2
UNION ALL SELECT gene_id, path_id, 'against_strand', count(*) FROM steps_ JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE b.pos < a.pos GROUP BY 1, 2 UNION ALL SELECT gene_id, path_id, 'bad_coincidence', count(*) FROM steps_ JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE b.pos = a.pos GROUP BY 1, 2
UNION ALL SELECT gene_id, path_id, 'repeated_edge', CAST(sum(k) AS BIGINT) FROM (SELECT gene_id, path_id, src, dst, count(*) AS k FROM {steps} GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) x GROUP BY 1, 2) SELECT * FROM v""".replace("steps_", "{steps}"))
def g4_graph(steps):
    """Roles as nodes at places 1 to 3: turns that go back are against the strand, and every fiftieth path declares one edge more."""
    nodes = steps.select("gene_id").distinct().select("gene_id", F.explode(F.create_map(F.lit("user"), F.lit(1), F.lit("assistant"), F.lit(2), F.lit("end"), F.lit(3))).alias("node_id", "pos")).withColumn("node_type", F.lit("donor"))
    edges = steps.select("gene_id", "edge_id", "src", "dst", F.lit("SPLICE").alias("edge_type"), F.lit(1).alias("span")).distinct()
    paths = steps.groupBy("gene_id", "path_id").agg((F.count("*") + F.when(F.col("path_id") % 50 == 0, 1).otherwise(0)).alias("n_edges")).withColumns({"strand": F.lit("+"), "start": F.lit("user"), "end": F.lit("end")})
    return gr.validate_graph(nodes, edges, paths, steps)


@query("g8_edge_features", "exons", None)
def g8_edges(exons):
    _, edges, steps = gr.compile_graph(exon_paths(exons).withColumn("strand", F.lit("+")))
    spans = gr.path_spans(steps, edges).groupBy("gene_id").agg(F.sum("log_span").alias("spans"), F.max("log_length").alias("longest"))
    per = gr.edge_features(edges, ["SPLICE", "RETAINED_INTRON", "EXON_CONTINUATION"]).groupBy("gene_id").agg(F.sum("is_splice").alias("splices"), F.sum("is_retained_intron").alias("retained"), F.sum("log_length").alias("log_length"))
    return per.join(spans, "gene_id")


SEQ = "s AS (SELECT gene_id, path_id, string_agg(edge_id, ',' ORDER BY edge_order) AS edges FROM {steps} GROUP BY 1, 2)"


@query("g5_collapse_identical", "steps", f"WITH {SEQ} SELECT gene_id, edges, min(path_id) AS path_id, count(*) AS n_paths FROM s GROUP BY 1, 2")
def g5(steps):
    return gr.collapse_identical(steps).select("gene_id", F.array_join("edges", ",").alias("edges"), "path_id", "n_paths")


@query("g6_local_adjacency", "steps", """WITH n AS (SELECT gene_id, edge_id AS a, lead(edge_id) OVER (PARTITION BY gene_id, path_id ORDER BY edge_order) AS b FROM {steps}) SELECT gene_id, a, b FROM n WHERE b IS NOT NULL UNION SELECT gene_id, b, a FROM n WHERE b IS NOT NULL""")
def g6(steps):
    return gr.local_adjacency(steps)


@query("g7_incidence_stats", "steps", """WITH n AS (SELECT gene_id, count(DISTINCT path_id) AS p FROM {steps} GROUP BY 1), m AS (SELECT s.gene_id, edge_id, count(DISTINCT path_id) / CAST(max(p) AS DOUBLE) AS m FROM {steps} s JOIN n ON n.gene_id = s.gene_id GROUP BY 1, 2)
SELECT gene_id, count(*) FILTER (m > 0 AND m < 1) AS variable_edges, round(sum(m * (1 - m)), 6) AS variance FROM m GROUP BY 1""")
def g7(steps):
    return gr.incidence_stats(steps).withColumn("variance", F.round("variance", 6))


@query("g8_path_features", "steps", "SELECT gene_id, path_id, round(ln(1 + count(*)), 6) AS log_edges, arg_min(edge_id, edge_order) AS first_edge, arg_max(edge_id, edge_order) AS last_edge FROM {steps} GROUP BY 1, 2")
def g8(steps):
    return gr.path_features(steps).withColumn("log_edges", F.round("log_edges", 6))


@query("g9_without_scaffold", "steps", "SELECT DISTINCT gene_id, edge_id, src, dst FROM {steps} WHERE dst <> 'end' AND src <> 'system'")
def g9(steps):
    return gr.without_scaffold(steps.select("gene_id", "edge_id", "src", "dst").distinct(), steps, ["end", "system"])


GROUPS = """i AS (SELECT p.gene_id, p.path_id, coalesce(string_agg(DISTINCT paths_key, '|' ORDER BY paths_key), '') AS sig FROM {paths} p LEFT JOIN {patterns} t ON t.gene_id = p.gene_id AND contains(';' || paths_key || ';', ';' || p.path_id || ';') GROUP BY 1, 2),
f AS (SELECT *, min(path_id) OVER (PARTITION BY gene_id, sig) AS first FROM i), gg AS (SELECT gene_id, path_id, gene_id || ':' || lpad(CAST(dense_rank() OVER (PARTITION BY gene_id ORDER BY first) - 1 AS VARCHAR), 4, '0') AS group_id FROM f)"""


def keyed(patterns):
    return patterns.withColumn("paths", F.split("paths_key", ";"))


@query("f1_observational_groups", "patterns paths", f"WITH {GROUPS} SELECT * FROM gg")
def f1(patterns, paths):
    return idf.observational_groups(keyed(patterns), paths)


@query("f2_exclusive_support", "patterns paths", f"""WITH {GROUPS}, o AS (SELECT t.gene_id, paths_key, mass, count(DISTINCT group_id) AS k, min(group_id) AS group_id FROM {{patterns}} t JOIN gg ON gg.gene_id = t.gene_id AND contains(';' || paths_key || ';', ';' || path_id || ';') GROUP BY 1, 2, 3),
s AS (SELECT group_id, CAST(sum(mass) AS BIGINT) AS m FROM o WHERE k = 1 GROUP BY 1) SELECT gg.gene_id, gg.group_id, count(*) AS n_paths, coalesce(max(m), 0) AS exclusive_mass FROM gg LEFT JOIN s ON s.group_id = gg.group_id GROUP BY 1, 2""")
def f2(patterns, paths):
    return idf.exclusive_support(keyed(patterns), idf.observational_groups(keyed(patterns), paths))


@query("f3_augmented_rank", "patterns paths")
def f3(patterns, paths):
    return idf.augmented_rank(keyed(patterns), idf.observational_groups(keyed(patterns), paths))


@query("f4_identifiability_index", "patterns paths")
def f4(patterns, paths):
    return idf.identifiability_index(keyed(patterns), paths)


@query("f5_classify_heldout", "ec_fates axis patterns paths")
def f5(ec, axis, patterns, paths):
    held = ec.where("split <> 'train'").join(axis.select("gene_id", "n_legal"), "gene_id")
    return idf.classify_heldout(keyed(held), idf.observational_groups(keyed(patterns), paths))


@query("f5_cell_support", "ec_fates axis patterns paths")
def f5_cells(ec, axis, patterns, paths):
    held = keyed(ec.where("split <> 'train'").join(axis.select("gene_id", "n_legal"), "gene_id"))
    groups = idf.observational_groups(keyed(patterns), paths)
    index = idf.augmented_rank(keyed(patterns), groups)
    return idf.cell_support(held, groups, index)


@query("f6_endpoint_choices", "steps", """WITH p AS (SELECT gene_id, CAST(path_id AS VARCHAR) AS path_id, arg_min(edge_id, edge_order) AS first_edge FROM {steps} GROUP BY 1, 2), a AS (SELECT gene_id, first_edge, string_agg(path_id, ',' ORDER BY path_id) AS paths, count(*) AS n_paths FROM p GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY gene_id) AS alternatives FROM a QUALIFY count(*) OVER (PARTITION BY gene_id) >= 2""")
def f6(steps):
    p = gr.path_features(steps).withColumn("path_id", F.col("path_id").cast("string"))
    return idf.endpoint_choices(p, "first_edge")


@query("f7_shared_context", "steps", f"""WITH {SEQ}, r AS (SELECT s.gene_id, s.path_id, split_part(edges, ',', 1) AS alt, len(string_split(edges, ',')) AS n, string_split(edges, ',') AS e FROM s),
x AS (SELECT gene_id, path_id, alt, k, array_to_string(e[n - k + 1:n], ',') AS run FROM r, range(1, 200) q(k) WHERE k <= n), y AS (SELECT gene_id, run FROM x GROUP BY 1, 2 HAVING count(DISTINCT alt) > 1),
m AS (SELECT x.gene_id, path_id, max(k) AS k FROM x JOIN y ON y.gene_id = x.gene_id AND y.run = x.run GROUP BY 1, 2) SELECT r.gene_id, r.path_id, alt AS alternative, CAST(coalesce(k, 0) AS INTEGER) AS shared, CASE WHEN k IS NULL THEN 'UNMATCHED' ELSE 'matched' END AS status FROM r LEFT JOIN m ON m.gene_id = r.gene_id AND m.path_id = r.path_id""")
def f7(steps):
    seq = steps.groupBy("gene_id", "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_order", "edge_id"))), lambda x: x.edge_id).alias("edges"))
    return idf.shared_context(seq.withColumn("alternative", F.element_at("edges", 1)))


PAIRS = "c AS (SELECT a.gene_id, a.choice_id, a.alternative_id AS a, b.alternative_id AS b, a.mass AS mass_a, b.mass AS mass_b, a.mass > 0 AND b.mass > 0 AS reportable FROM {alternatives} a JOIN {alternatives} b ON a.gene_id = b.gene_id AND a.choice_id = b.choice_id AND a.alternative_id < b.alternative_id)"


@query("f9_contrasts", "alternatives", f"WITH {PAIRS} SELECT * FROM c")
def f9(alternatives):
    return idf.contrasts(alternatives)


@query("f9_estimable_contrasts", "patterns paths")
def f9_estimable(patterns, paths):
    """A choice per gene between the first words of its paths; the last word is the context."""
    words = F.split(F.substring_index("path_id", "|", -1), " ")
    p = paths.withColumns({"choice_id": F.concat(F.lit("choice:"), "gene_id"), "alternative_id": words[0], "context": F.element_at(words, -1), "eligible": F.lit(True)})
    alternatives = p.groupBy("gene_id", "choice_id", "alternative_id").agg(F.collect_set("path_id").alias("paths"))
    pairs = idf.subset_contrasts(alternatives, p)
    out = idf.estimable_contrasts(pairs, keyed(patterns), idf.observational_groups(keyed(patterns), paths))
    return out.withColumns({c: F.array_join(c, ";") for c in ("paths_a", "paths_b", "crossing")})


SUPPORT = f"""{PAIRS}, k AS (SELECT DISTINCT cell_id, gene_id FROM {{molecules}}), m AS (SELECT cell_id, gene_id, donor_id || qc_pass AS alternative_id, CAST(sum(n) AS BIGINT) AS mass FROM {{molecules}} GROUP BY 1, 2, 3),
h AS (SELECT k.cell_id, k.gene_id, choice_id, a, b, coalesce(x.mass, 0) AS mass_a, coalesce(y.mass, 0) AS mass_b FROM k JOIN c ON c.gene_id = k.gene_id LEFT JOIN m x ON x.cell_id = k.cell_id AND x.gene_id = k.gene_id AND x.alternative_id = a LEFT JOIN m y ON y.cell_id = k.cell_id AND y.gene_id = k.gene_id AND y.alternative_id = b),
t AS (SELECT *, CASE WHEN mass_a > 0 AND mass_b > 0 THEN 'both' WHEN mass_a > 0 OR mass_b > 0 THEN 'one' ELSE 'none' END AS tier FROM h)"""


def contrast_rows(alternatives, molecules):
    mass = molecules.groupBy("cell_id", "gene_id", F.concat("donor_id", F.col("qc_pass").cast("string")).alias("alternative_id")).agg(F.sum("n").alias("mass"))
    return idf.heldout_contrast_support(molecules.select("cell_id", "gene_id").distinct(), idf.contrasts(alternatives), mass)


@query("f10_contrast_support", "alternatives molecules", f"WITH {SUPPORT} SELECT cell_id, gene_id, choice_id, a, b, mass_a, mass_b, tier FROM t")
def f10(alternatives, molecules):
    return contrast_rows(alternatives, molecules).select("cell_id", "gene_id", "choice_id", "a", "b", "mass_a", "mass_b", "tier")


@query("f11_coverage_tables", "alternatives molecules", f"""WITH {SUPPORT}, l AS (SELECT choice_id AS scope, cell_id % 2 AS split, tier FROM t UNION ALL SELECT 'all', cell_id % 2, tier FROM t), g AS (SELECT split, scope FROM (SELECT DISTINCT cell_id % 2 AS split FROM t) s, (VALUES ('all'), ('A'), ('N'), ('R'), ('X')) v(scope)),
o AS (SELECT scope, split, count(*) AS eligible, count(*) FILTER (tier <> 'none') AS touched, count(*) FILTER (tier = 'both') AS estimable FROM l GROUP BY 1, 2) SELECT g.scope, g.split, coalesce(eligible, 0) AS eligible, coalesce(touched, 0) AS touched, coalesce(estimable, 0) AS estimable FROM g LEFT JOIN o ON o.scope = g.scope AND o.split = g.split""")
def f11(alternatives, molecules):
    r = contrast_rows(alternatives, molecules).select(F.col("choice_id").alias("scope"), (F.col("cell_id") % 2).alias("split"), "tier")
    return idf.coverage_tables(r, ["A", "N", "R", "X"])
