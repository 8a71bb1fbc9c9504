"""Queries of anchors, choices, identity and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import hash32
from ..operators import graph as gr
from ..operators import identify as idf
from ..operators import intervals as iv
from ..operators import metrics, regress, split
from .bindings import query
from .interval_plans import exon_paths


@query("i5_anchor_regions", "part nation supplier", """WITH n AS (SELECT p_size AS gene_id, 'n' || p_partkey AS node_id, CASE p_partkey % 4 WHEN 0 THEN 'TSS' WHEN 1 THEN 'donor' WHEN 2 THEN 'acceptor' ELSE 'SINK' END AS node_type, p_partkey % 3000 AS pos, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part),
e AS (SELECT p_size AS gene_id, 'e' || p_partkey AS edge_id, 'n' || p_partkey AS src, 'n' || (p_partkey + 1) AS dst, p_partkey % 3000 AS lo, p_partkey % 3000 + p_partkey % 900 AS hi, CASE WHEN p_partkey % 2 = 0 THEN 'EXON_CONTINUATION' ELSE 'SPLICE' END AS edge_type, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part),
w AS (SELECT *, CASE WHEN strand = '-' THEN pos - d ELSE pos - u END AS rs, CASE WHEN strand = '-' THEN pos + u ELSE pos + d END AS re FROM (SELECT *, CASE node_type WHEN 'TSS' THEN 100 ELSE 30 END AS u, CASE node_type WHEN 'TSS' THEN 50 ELSE 60 END AS d FROM n WHERE node_type <> 'SINK') x),
s AS (SELECT w.gene_id, w.gene_id || ':site:' || node_id AS anchor_id, edge_id, w.strand, greatest(0, rs) AS s, least(2900, re) AS e, 'site' AS kind, node_type AS anchor_type, rs < 0 OR re > 2900 AS clipped FROM w JOIN e ON e.gene_id = w.gene_id AND CASE WHEN node_type IN ('TSS', 'donor') THEN src ELSE dst END = node_id WHERE least(2900, re) > greatest(0, rs))
SELECT * FROM s UNION ALL SELECT gene_id, gene_id || ':edge:' || edge_id, edge_id, strand, lo, hi, 'edge', 'EDGE', false FROM e WHERE hi > lo AND edge_type = 'EXON_CONTINUATION' AND hi - lo <= 500""")
def i5(part, nation, supplier):
    k = F.col("p_partkey")
    strand = F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand")
    kind = F.when(k % 4 == 0, "TSS").when(k % 4 == 1, "donor").when(k % 4 == 2, "acceptor").otherwise("SINK")
    nodes = part.select(F.col("p_size").alias("gene_id"), F.concat(F.lit("n"), k).alias("node_id"), kind.alias("node_type"), (k % 3000).alias("pos"), strand, F.lit("chr1").alias("chrom"))
    edges = part.select(
        F.col("p_size").alias("gene_id"), F.concat(F.lit("e"), k).alias("edge_id"), F.concat(F.lit("n"), k).alias("src"), F.concat(F.lit("n"), k + 1).alias("dst"), (k % 3000).alias("lo"), (k % 3000 + k % 900).alias("hi"),
        F.when(k % 2 == 0, "EXON_CONTINUATION").otherwise("SPLICE").alias("edge_type"), strand,
    )
    contigs = part.sparkSession.createDataFrame([("chr1", 2900)], "chrom string, length long")
    return iv.anchor_regions(nodes, edges, {"TSS": (100, 50), "donor": (30, 60), "acceptor": (30, 60)}, contigs, "RNA", 500)


@query("f8_internal_choices", "exons")
def f8(exons):
    """Nodes are numbers, position and type in one, until the alternatives are found."""
    d = gr.stepped_paths(exon_paths(exons).withColumn("strand", F.lit("+")))
    code = lambda v, pos, kind: v[pos] * len(gr.TYPES) + v[kind]
    each = lambda f, name: F.transform("steps", f).alias(name)
    kinds = ["SPLICE", "RETAINED_INTRON", "EXON_CONTINUATION"]
    place = F.array(*map(F.lit, kinds))
    paths = d.select(
        "gene_id", F.col("path_id").cast("string").alias("path_id"), each(lambda v: (F.array_position(place, v.edge_type) - 1).cast("byte"), "edge"),
        each(lambda v: code(v, "pos", "type"), "src"), each(lambda v: code(v, "dst_pos", "dst_type"), "dst"),
    )
    names = F.array(*map(F.lit, gr.TYPES))
    node = lambda v: F.concat_ws(":", "gene_id", F.get(names, F.pmod(v, F.lit(len(gr.TYPES)))), F.floor(v / len(gr.TYPES)))
    edge = lambda v: F.concat_ws(">", node(v.src), node(v.dst), F.get(place, v.edge))
    out = idf.named_choices(idf.path_choices(paths), node, edge)
    return out.select("gene_id", "choice_id", "alternative_id", F.array_join("edges", ",").alias("edges"), F.array_join("paths", ",").alias("paths"))


@query("l11_gtf_crosscheck", "part", """WITH p AS (SELECT p_partkey AS path_id, p_brand AS gene_id, p_size AS x FROM part), a AS (SELECT DISTINCT p_brand AS gene_id, p_size AS x FROM part WHERE p_partkey % 50 = 0), b AS (SELECT DISTINCT p_brand AS gene_id, p_size AS x FROM part WHERE p_partkey % 51 = 0)
SELECT path_id, concat_ws(',', CASE WHEN a.x IS NOT NULL THEN 'a' END, CASE WHEN b.x IS NOT NULL THEN 'b' END) AS sources FROM p LEFT JOIN a ON a.gene_id = p.gene_id AND a.x = p.x LEFT JOIN b ON b.gene_id = p.gene_id AND b.x = p.x""")
def l11(part):
    p = part.select(F.col("p_partkey").alias("path_id"), F.col("p_brand").alias("gene_id"), F.lit("chr1").alias("chrom"), F.lit("+").alias("strand"), F.array(F.struct(F.col("p_size").alias("s"), (F.col("p_size") + 5).alias("e"))).alias("exons"))
    out = split.gtf_crosscheck(p, {"a": p.where("path_id % 50 = 0"), "b": p.where("path_id % 51 = 0")})
    return out.select("path_id", F.array_join("sources", ",").alias("sources"))


@query("m12_matrix_identity", "part", """WITH v(violation, violations) AS (VALUES ('row_repeated', 0), ('identity_differs', 0), ('path_mapped_twice', 0), ('alias_of_two_paths', 0), ('alias_of_another_path', 0), ('path_not_in_model', 0))
SELECT * FROM v UNION ALL SELECT 'row_unresolved', count(*) FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'path_not_in_matrix', count(*) FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT 'alias_absent', count(*) FROM part WHERE p_partkey % 10 > 0 AND p_partkey % 7 = 0 UNION ALL SELECT 'alias_extra', count(*) FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 7 = 0""")
def m12(part):
    k = F.col("p_partkey")
    rows = part.select(k.alias("row_id"), F.concat(F.lit("t"), k).alias("tx_id"), F.col("p_brand").alias("gene_id"))
    cross = rows.where("row_id % 10 > 0").withColumn("path_id", F.concat(F.lit("p"), "row_id"))
    paths = part.select(F.col("p_brand").alias("gene_id"), F.concat(F.lit("p"), k).alias("path_id"), F.array(F.when(k % 7 == 0, F.concat(F.lit("u"), k)).otherwise(F.concat(F.lit("t"), k))).alias("aliases"))
    return metrics.matrix_identity(rows, cross, paths)


@query("m13_monitor_record", "dealt_units", """SELECT (SELECT round(sum(nll * mass) / sum(mass), 6) FROM {nll_rows}) AS nll, (SELECT CAST(sum(mass) AS BIGINT) FROM {nll_rows}) AS nll_mass, round(sum(kl * total) / sum(total), 6) AS kl, count(*) AS kl_cell_genes
FROM (SELECT cell_id, gene_id, greatest(sum(CASE WHEN q > 0 THEN q * (ln(q) - logp) ELSE 0 END), 0) AS kl, max(total) AS total FROM {observed} GROUP BY 1, 2) x""")
def m13(units):
    return metrics.monitor_record(units).select(F.round("nll", 6).alias("nll"), "nll_mass", F.round("kl", 6).alias("kl"), "kl_cell_genes")


NUISANCE = (["log_mass", "rows"], ["gene_group", "donor"])
STATE = ([*NUISANCE[0], "pc1", "pc2"], [*NUISANCE[1], "stage"])


def residual_rows(lineitem):
    return lineitem.select(
        F.col("l_extendedprice").alias("y"), (F.col("l_tax") + 0.1).alias("w"), "l_orderkey", F.log1p("l_tax").alias("log_mass"), F.col("l_linenumber").alias("rows"),
        F.col("l_returnflag").alias("gene_group"), F.col("l_linestatus").alias("donor"), F.month("l_shipdate").alias("stage"), F.col("l_quantity").alias("pc1"), F.col("l_discount").alias("pc2"),
    )


@query("m15_ridge_diagnostics", "lineitem")
def m15(lineitem):
    """Nuisance columns alone, and with those of the state, on the same rows, folds and strengths."""
    fits = regress.ridge_designs(residual_rows(lineitem), {"nuisance": NUISANCE, "state": STATE}, "y", "w", "l_orderkey", [0.1, 10.0, 1e6])
    return regress.ridge_report(fits, lineitem.sparkSession)


@query("m16_residual_gate", "lineitem")
def m16_residual(lineitem):
    """Fits of two thirds of the orders, judged on the last third."""
    d = residual_rows(lineitem).withColumn("part", hash32(F.lit("part"), "l_orderkey") % 3)
    fits = regress.ridge_designs(d.where("part > 0"), {"nuisance": NUISANCE, "state": STATE}, "y", "w", "l_orderkey", [0.1, 10.0])
    return metrics.residual_gate(fits["nuisance"], fits["state"], d.where("part = 0").withColumn("high", F.col("rows") > 3), "y", "w", "high")
