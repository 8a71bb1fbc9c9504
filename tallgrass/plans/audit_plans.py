"""Queries of aggregations, audits and evidence classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .bindings import BINDINGS, query

BINDINGS["molecule_fates"] = """SELECT cell_id, gene_id, library_id, donor_id, umi, n, qc_pass, CASE WHEN HASH(umi || '|' || path_id) % 5 = 0 THEN 'empty'
    WHEN HASH(umi || '|' || path_id) % 5 = 1 THEN 'full' ELSE 'informative' END AS fate FROM {molecules}"""
FATES = ["empty", "informative", "full"]


@query("a1_grouping_sets", "molecules", """SELECT CASE grouping_id(library_id, donor_id, gene_id) WHEN 7 THEN 'global' WHEN 3 THEN 'library_id' WHEN 1 THEN 'library_idxdonor_id' ELSE 'library_idxgene_id' END AS stratum_type,
concat_ws(',', library_id, donor_id, gene_id) AS stratum_values, count(*) AS rows, CAST(sum(n) AS BIGINT) AS mass FROM {molecules}
GROUP BY GROUPING SETS ((), (library_id), (library_id, donor_id), (library_id, gene_id))""")
def a1(molecules):
    out = audit.multi_strata(molecules, [[], ["library_id"], ["library_id", "donor_id"], ["library_id", "gene_id"]], [F.count("*").alias("rows"), F.sum("n").alias("mass")])
    return out.withColumn("stratum_values", F.array_join("stratum_values", ","))


@query("a2_fate_waterfall", "ec_fates", """WITH g AS (SELECT split, fate FROM (SELECT DISTINCT split FROM {ec_fates}) s, (VALUES ('empty'), ('informative'), ('full')) f(fate)),
o AS (SELECT split, fate, count(*) AS rows, CAST(sum(mass) AS BIGINT) AS mass FROM {ec_fates} GROUP BY 1, 2),
j AS (SELECT g.split, g.fate, coalesce(rows, 0) AS rows, coalesce(mass, 0) AS mass FROM g LEFT JOIN o ON o.split = g.split AND o.fate = g.fate)
SELECT *, round(mass / CAST(sum(mass) OVER (PARTITION BY split) AS DOUBLE), 6) AS fraction, 'estimable' AS status FROM j""")
def a2(ec):
    return audit.fate_waterfall(ec, ["split"], FATES).withColumn("fraction", F.round("fraction", 6))


@query("a3_opportunity_audit", "molecules", """SELECT library_id, CAST(sum(n) AS BIGINT) AS captured, CAST(sum(n) FILTER (qc_pass) AS BIGINT) AS qc_mass, CAST(sum(n) FILTER (qc_pass AND n % 3 > 0) AS BIGINT) AS supported_mass,
CAST(sum(n) FILTER (qc_pass AND n % 2 > 0) AS BIGINT) AS censored_mass, CAST(sum(n * (n % 3)) FILTER (qc_pass) AS BIGINT) AS supported_opportunities,
round(sum(n) FILTER (qc_pass AND n % 3 > 0) / CAST(sum(n) FILTER (qc_pass) AS DOUBLE), 6) AS supported_fraction FROM {molecules} GROUP BY 1""")
def a3(molecules):
    m = molecules.withColumns({"mass": F.col("n"), "supported": F.col("n") % 3, "censored": F.col("n") % 2})
    return audit.opportunity_audit(m, ["library_id"]).withColumn("supported_fraction", F.round("supported_fraction", 6))


@query("a4_partial_merge", "molecules", """SELECT gene_id, CAST(sum(n) AS BIGINT) AS captured, CAST(sum(n) FILTER (qc_pass) AS BIGINT) AS qc_mass, CAST(sum(n) FILTER (NOT qc_pass) AS BIGINT) AS technical, true AS conserved FROM {molecules} GROUP BY 1""")
def a4(molecules):
    q = F.col("qc_pass")
    part = lambda d: d.groupBy("gene_id").agg(F.sum("n").alias("captured"), F.sum(F.when(q, F.col("n")).otherwise(0)).alias("qc_mass"), F.sum(F.when(~q, F.col("n")).otherwise(0)).alias("technical"))
    return audit.partial_merge([part(molecules.where(F.col("donor_id") == d)) for d in ("F", "O")], ["gene_id"], ["captured", "qc_mass", "technical"])


@query("a5_qc_status", "molecules", """WITH g AS (SELECT gene_id, library_id, count(*) AS total, count(*) FILTER (qc_pass) AS passed FROM {molecules} GROUP BY 1, 2)
SELECT gene_id, library_id, CASE WHEN library_id <> 'R' THEN round(passed / CAST(total AS DOUBLE), 6) END AS fraction, CASE WHEN library_id = 'R' THEN 'not_performed' ELSE 'performed' END AS status FROM g""")
def a5(molecules):
    g = molecules.groupBy("gene_id", "library_id").agg(F.count("*").alias("total"), F.count_if("qc_pass").alias("passed"))
    out = audit.qc_status(g, F.col("library_id") != "R", F.col("passed"), F.col("total"))
    return out.select("gene_id", "library_id", F.round("fraction", 6).alias("fraction"), "status")


@query("a6_coverage", "molecules", """SELECT library_id, donor_id, count(*) AS eligible, count(*) FILTER (qc_pass) AS inside, count(*) FILTER (qc_pass AND n > 10) AS legal, count(*) FILTER (qc_pass AND n > 10 AND umi % 2 = 0) AS retained FROM {molecules} GROUP BY 1, 2""")
def a6(molecules):
    return audit.cumulative_coverage(molecules, ["library_id", "donor_id"], {"inside": F.col("qc_pass"), "legal": F.col("n") > 10, "retained": F.col("umi") % 2 == 0})


@query("a7_weighted_moments", "lineitem", """WITH m AS (SELECT l_returnflag AS g, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS mean FROM lineitem GROUP BY 1)
SELECT g, round(max(mean), 4) AS mean, round(sum(l_quantity * pow(l_extendedprice - mean, 2)) / sum(l_quantity) / 1e6, 4) AS variance_m, round(pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 4) AS n_eff
FROM lineitem JOIN m ON l_returnflag = g GROUP BY 1""")
def a7(lineitem):
    out = audit.weighted_moments(lineitem.withColumnRenamed("l_returnflag", "g"), ["g"], "l_extendedprice", "l_quantity")
    return out.select("g", F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1e6, 4).alias("variance_m"), F.round("n_eff", 4).alias("n_eff"))


@query("a8_weighted_quantile", "lineitem", """WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY x) AS cum, sum(w) OVER (PARTITION BY g) AS total FROM d)
SELECT g, min(x) FILTER (cum >= 0.95 * total) AS quantile FROM c GROUP BY 1""")
def a8(lineitem):
    return audit.weighted_quantile(lineitem.withColumnRenamed("l_returnflag", "g"), ["g"], "l_extendedprice", "l_quantity", 0.95)


@query("a9_quantiles", "orders", """WITH s AS (SELECT o_orderpriority AS g, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT g, round(quantile_cont(x, 0.95), 4) AS linear, round(max(x) FILTER (k = CAST(ceil(0.95 * (n - 1)) AS BIGINT) + 1), 4) AS higher, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr FROM s GROUP BY 1""")
def a9(orders):
    out = audit.quantiles(orders.withColumnRenamed("o_orderpriority", "g"), ["g"], "o_totalprice", 0.95)
    return out.select("g", *(F.round(c, 4).alias(c) for c in ("linear", "higher", "median", "iqr")))


@query("a10_weighted_r2", "lineitem", """WITH m AS (SELECT l_returnflag AS g, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT g, round(1 - sum(l_quantity * pow(l_extendedprice - l_quantity * 1100, 2)) / sum(l_quantity * pow(l_extendedprice - m, 2)), 6) AS r2 FROM lineitem JOIN m ON l_returnflag = g GROUP BY 1""")
def a10(lineitem):
    d = lineitem.withColumn("p", F.col("l_quantity") * 1100).withColumnRenamed("l_returnflag", "g")
    return audit.weighted_r2(d, ["g"], "l_extendedprice", "p", "l_quantity").withColumn("r2", F.round("r2", 6))


@query("a11_pooled_counts", "counts cells", "SELECT cell_type, path_id, CAST(sum(n) AS BIGINT) AS n FROM {counts} c JOIN {cells} x ON x.cell_id = c.cell_id GROUP BY 1, 2")
def a11(counts, cells):
    return audit.pooled_counts(counts, cells)


@query("a12_gene_counts", "counts", "SELECT gene_id, cell_id, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS positive_paths FROM {counts} GROUP BY 1, 2")
def a12(counts):
    return audit.gene_counts(counts)


@query("c6_fate", "ec axis", """SELECT cell_id, e.gene_id, CASE WHEN paths_key = axis_key THEN 'full' ELSE 'informative' END AS fate FROM {ec} e JOIN {axis} a ON a.gene_id = e.gene_id""")
def c6(ec, axis):
    return ec.join(axis, "gene_id").select("cell_id", "gene_id", audit.fate(F.split("paths_key", ";"), F.col("n_legal")).alias("fate"))


@query("c8_dedupe_check", "molecules", "SELECT cell_id, gene_id, umi, count(*) AS records FROM {molecules} GROUP BY 1, 2, 3 HAVING count(*) > 1")
def c8(molecules):
    return audit.duplicate_molecules(molecules, ["cell_id", "gene_id", "umi"])


@query("c9_aggregate_ec", "molecule_fates", """WITH g AS (SELECT gene_id, cell_id, library_id, donor_id, qc_pass, fate, count(*) AS molecule_count FROM {molecule_fates} GROUP BY ALL)
SELECT *, 'ec:' || gene_id || ':' || lpad(CAST(row_number() OVER (PARTITION BY gene_id ORDER BY cell_id, library_id, donor_id, qc_pass, fate) AS VARCHAR), 8, '0') AS class_id FROM g""")
def c9(molecules):
    return audit.aggregate_ec(molecules, ["cell_id", "library_id", "donor_id", "qc_pass", "fate"])


MASS_SQL = """SELECT cell_id, gene_id, count(*) AS captured, count(*) FILTER (qc_pass) AS qc_mass, count(*) FILTER (NOT qc_pass) AS technical, count(*) FILTER (qc_pass AND fate = 'empty') AS empty_mass,
count(*) FILTER (qc_pass AND fate = 'informative') AS informative_mass, count(*) FILTER (qc_pass AND fate = 'full') AS full_mass FROM {molecule_fates} GROUP BY 1, 2"""


@query("c10_cell_gene_mass", "molecule_fates", MASS_SQL)
def c10(molecules):
    return audit.cell_gene_mass(molecules)


@query("c13_reconcile", "molecule_fates counts", f"""WITH m AS ({MASS_SQL}), c AS (SELECT gene_id, cell_id, CAST(sum(n) AS BIGINT) AS matrix, count(*) AS positive_paths FROM {{counts}} WHERE cell_id % 5 > 0 GROUP BY 1, 2),
j AS (SELECT m.cell_id, m.gene_id, captured, coalesce(matrix, 0) AS matrix, coalesce(positive_paths, 0) AS positive_paths FROM m LEFT JOIN c ON c.gene_id = m.gene_id AND c.cell_id = m.cell_id)
SELECT *, CASE WHEN matrix = 0 THEN 'zero_total' WHEN positive_paths < 2 THEN 'under_two_positive' ELSE 'eligible' END AS scope,
CASE WHEN matrix = captured THEN 'equal' WHEN matrix > captured THEN 'matrix_above' ELSE 'matrix_below' END AS relation, matrix - captured AS difference FROM j""")
def c13(molecules, counts):
    out = audit.reconcile(audit.cell_gene_mass(molecules), counts.where("cell_id % 5 > 0"))
    return out.select("cell_id", "gene_id", "captured", "matrix", "positive_paths", "scope", "relation", "difference")


@query("c14_equivalence_patterns", "ec_fates", "SELECT gene_id, paths_key, count(*) AS row_count, CAST(sum(mass) AS BIGINT) AS mass FROM {ec_fates} WHERE split = 'train' AND fate = 'informative' GROUP BY 1, 2")
def c14(ec):
    return audit.equivalence_patterns(ec)
