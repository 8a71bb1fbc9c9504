"""Queries of splits, support and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, split
from .bindings import BINDINGS, query

SPLIT_SQL = """s AS (SELECT cell_id, stratum, sha256('{{"split_seed":7,"stratum":' || stratum || ',"id":' || cell_id || '}}') AS key FROM {cells}),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, cell_id) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM s),
x AS (SELECT cell_id, stratum, key, CASE WHEN k <= n - 2 * floor(n * 0.1) THEN 'train' WHEN k <= n - floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r)""".replace("{{", "{").replace("}}", "}")

BINDINGS |= {
    "ec_fates": """SELECT e.cell_id, e.gene_id, paths_key, mass, s.split, CASE WHEN paths_key = axis_key THEN 'full' ELSE 'informative' END AS fate
        FROM {ec} e JOIN {axis} a ON a.gene_id = e.gene_id JOIN {cell_split} s ON s.cell_id = e.cell_id""",
    "support": """SELECT p.gene_id, p.path_id, coalesce(total, 0) AS total, coalesce(positive_cells, 0) AS positive_cells FROM {paths} p LEFT JOIN
        (SELECT path_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS positive_cells FROM {counts} c JOIN {cell_split} s ON s.cell_id = c.cell_id WHERE split = 'train' AND n > 0 GROUP BY 1) t
        ON t.path_id = p.path_id""",
}


@query("l1_hash_split", "cells", f"WITH {SPLIT_SQL} SELECT cell_id, stratum, key, split FROM x")
def l1(cells):
    return split.stratified_hash_split(cells, 7).select("cell_id", "stratum", "key", "split")


@query("l2_split_summary", "cells", f"WITH {SPLIT_SQL} SELECT stratum, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM x GROUP BY 1")
def l2(cells):
    return split.split_summary(split.stratified_hash_split(cells, 7))


@query("l3_normalize_name", "part", "SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS norm FROM part")
def l3(part):
    return part.select("p_partkey", split.normalize_name(F.col("p_name")).alias("norm"))


@query("l4_crosswalk", "part", """WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN 'G' || p_partkey || '_nr_' || p_partkey WHEN p_partkey % 4 = 1 THEN 'x-ENST' || lpad(CAST(p_partkey AS VARCHAR), 11, '0')
 WHEN p_partkey % 4 = 2 THEN p_name ELSE 'L' || p_partkey END AS name FROM part),
k AS (SELECT upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS norm, min(p_brand) AS by_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1),
x AS (SELECT name, CASE WHEN regexp_matches(name, '^L[0-9]*0$') THEN name || '-old' END AS a, nullif(regexp_extract(name, '(ENST[0-9]{11})', 1), '') AS b,
 CASE WHEN regexp_matches(name, '_nr_[0-9]+$') THEN regexp_replace(name, '_nr_[0-9]+$', '') || '_nr_' || lpad(ltrim(regexp_extract(name, '_nr_([0-9]+)$', 1), '0'), 6, '0') END AS c, by_name AS d
 FROM n LEFT JOIN k ON k.norm = upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')))
SELECT name, coalesce(a, b, c, d) AS resolved, CASE WHEN a IS NOT NULL THEN 'legacy' WHEN b IS NOT NULL THEN 'embedded' WHEN c IS NOT NULL THEN 'novel' WHEN d IS NOT NULL THEN 'name' END AS rule FROM x""")
def l4(part):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("G"), k, F.lit("_nr_"), k)).when(k % 4 == 1, F.concat(F.lit("x-ENST"), F.lpad(k.cast("string"), 11, "0"))).when(k % 4 == 2, F.col("p_name")).otherwise(F.concat(F.lit("L"), k))
    names = part.select(name.alias("name")).distinct()
    legacy = names.where(F.col("name").rlike("^L[0-9]*0$")).select("name", F.concat("name", F.lit("-old")).alias("target"))
    return split.resolve_crosswalk(names, legacy, part.select(F.col("p_brand").alias("target"), F.col("p_name").alias("name")))


@query("l5_feature_support", "counts cell_split paths", "SELECT gene_id, path_id, total, positive_cells FROM {support}")
def l5(counts, cell_split, paths):
    return split.feature_support(counts, cell_split.where("split = 'train'"), paths)


@query("l6_gene_audit", "support", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY total DESC, path_id) AS rn FROM {support})
SELECT gene_id, count(*) AS n_paths, count(*) FILTER (total > 0) AS observed_paths, CAST(sum(total) AS BIGINT) AS total, max(path_id) FILTER (rn = 1) AS top1, max(total) FILTER (rn = 1) AS top1_count,
max(path_id) FILTER (rn = 2) AS top2, max(total) FILTER (rn = 2) AS top2_count, max(path_id) FILTER (rn = 3) AS top3, max(total) FILTER (rn = 3) AS top3_count,
CAST(sum(CASE WHEN rn > 1 THEN total ELSE 0 END) AS BIGINT) AS non_dominant, count(*) FILTER (total >= 2 AND positive_cells >= 2) AS paths_ge_2,
count(*) FILTER (total >= 5 AND positive_cells >= 5) AS paths_ge_5, count(*) FILTER (total >= 10 AND positive_cells >= 10) AS paths_ge_10 FROM r GROUP BY 1""")
def l6(support):
    return split.gene_audit(support)


@query("l7_stratum_breadth", "counts cells", """WITH s AS (SELECT gene_id, stratum, count(DISTINCT path_id) AS k FROM {counts} c JOIN {cells} x ON x.cell_id = c.cell_id WHERE n > 0 GROUP BY 1, 2)
SELECT gene_id, count(*) FILTER (k >= 2) AS strata_ge_2, count(*) FILTER (k >= 3) AS strata_ge_3 FROM s GROUP BY 1""")
def l7(counts, cells):
    return split.stratum_breadth(counts, cells)


LOCI = "SELECT s_nationkey AS gene_id, CASE WHEN s_suppkey % 40 = 0 THEN 'chrM' ELSE 'chr' || (s_nationkey % 22 + 1) END AS chrom, CASE WHEN s_nationkey % 3 = 0 AND s_suppkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM {supplier}"
BINDINGS["loci"] = LOCI


@query("l8_location_class", "loci", """WITH b AS (SELECT gene_id, string_agg(DISTINCT chrom, '|' ORDER BY chrom) AS chroms, string_agg(DISTINCT strand, '|' ORDER BY strand) AS strands FROM {loci} GROUP BY 1)
SELECT *, CASE WHEN contains(chroms, '|') OR contains(strands, '|') THEN 'alternative' WHEN chroms = 'chrM' THEN 'mitochondrial' ELSE 'nuclear' END AS location FROM b""")
def l8(loci):
    return split.location_class(loci)


@query("l9_selection_tiers", "support", """WITH a AS (SELECT gene_id, count(*) FILTER (total > 200) AS n_paths FROM {support} GROUP BY 1), c AS (SELECT *, length(gene_id) % 2 = 0 AS can FROM a)
SELECT gene_id, n_paths, CASE WHEN can AND n_paths >= 2 THEN 'selected' WHEN NOT can AND n_paths > 2 THEN 'conditional' ELSE 'excluded' END AS tier,
CASE WHEN can AND n_paths >= 2 THEN 'canonical_multi_path' WHEN NOT can AND n_paths > 2 THEN 'alternative_multi_path' WHEN n_paths < 2 THEN 'single_path' ELSE 'alternative_few_paths' END AS tier_reason FROM c""")
def l9(support):
    audit = support.groupBy("gene_id").agg(F.count_if(F.col("total") > 200).alias("n_paths"))
    return split.selection_tiers(audit, F.length("gene_id") % 2 == 0)


@query("l10_train_fit_axis", "ec_fates paths", """SELECT g.gene_id, coalesce(m, 0) AS train_mass, m IS NOT NULL AS fits FROM (SELECT DISTINCT gene_id FROM {paths}) g LEFT JOIN
(SELECT gene_id, CAST(sum(mass) AS BIGINT) AS m FROM {ec_fates} WHERE split = 'train' AND fate = 'informative' GROUP BY 1) t ON t.gene_id = g.gene_id""")
def l10(ec, paths):
    return split.train_fit_axis(ec, paths)


@query("l12_symbol_axis", "part", """SELECT upper(substr(p_name, 1, 4)) AS symbol, count(DISTINCT p_brand) AS n_genes, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS gene_id FROM part GROUP BY 1""")
def l12(part):
    return split.symbol_axis(part.select(F.substring("p_name", 1, 4).alias("symbol"), F.col("p_brand").alias("gene_id")))


@query("l13_expected_axis", "ec_fates", """SELECT gene_id, cell_id, row_number() OVER (ORDER BY gene_id, cell_id) - 1 AS i FROM (SELECT DISTINCT gene_id, cell_id FROM {ec_fates} WHERE split = 'val' AND fate = 'informative') x""")
def l13(ec):
    return contracts.numbered(split.expected_cell_gene_axis(ec), ["gene_id", "cell_id"])


@query("l14_count_target", "counts paths cell_split", """WITH p AS (SELECT path_id, row_number() OVER (ORDER BY path_id) - 1 AS path_i FROM {paths}), c AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS cell_i FROM {cell_split} WHERE split = 'val')
SELECT path_i, cell_i, n FROM {counts} x JOIN p ON p.path_id = x.path_id JOIN c ON c.cell_id = x.cell_id""")
def l14(counts, paths, cell_split):
    p = contracts.numbered(paths.select("path_id"), ["path_id"], "path_i")
    return split.build_count_target(counts, p, contracts.numbered(cell_split.where("split = 'val'").select("cell_id"), ["cell_id"], "cell_i"))


@query("l15_cell_key_lookup", "customer nation", """SELECT 'N' || c_nationkey || '_' || repeat('ACGT', c_custkey % 3 + 1) AS name, 'N' || c_nationkey AS prefix, repeat('ACGT', c_custkey % 3 + 1) AS barcode, n_name AS donor_id, n_regionkey AS library_id
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 4""")
def l15(customer, nation):
    cells = customer.select(F.concat(F.lit("N"), "c_nationkey", F.lit("_"), F.expr("repeat('ACGT', cast(c_custkey % 3 + 1 as int))")).alias("name"))
    libs = nation.where("n_regionkey < 4").select(F.concat(F.lit("N"), "n_nationkey").alias("prefix"), F.col("n_name").alias("donor_id"), F.col("n_regionkey").alias("library_id"))
    return split.cell_key_lookup(cells, libs).select("name", "prefix", "barcode", "donor_id", "library_id")


@query("l16_factor_catalog", "part nation", """WITH m AS (SELECT p_size AS entity_id, p_brand AS gene_id, CASE WHEN p_size % 2 = 0 THEN 'group' ELSE 'single' END AS kind FROM part),
b AS (SELECT entity_id, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS members, count(*) FILTER (gene_id LIKE '%1%') AS off_axis, min(kind) AS kind, count(DISTINCT gene_id) AS k FROM m GROUP BY 1)
SELECT entity_id, members, off_axis, CASE WHEN kind = 'group' AND k < 2 THEN 'group_too_small' WHEN off_axis > 0 THEN 'member_off_axis' ELSE 'valid' END AS status FROM b""")
def l16(part, nation):
    mapping = part.select(F.col("p_size").alias("entity_id"), F.col("p_brand").alias("gene_id"), F.when(F.col("p_size") % 2 == 0, "group").otherwise("single").alias("kind"))
    return split.factor_catalog(mapping, part.where("p_brand NOT LIKE '%1%'").select(F.col("p_brand").alias("gene_id")))
