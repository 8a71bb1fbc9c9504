"""Queries of contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from .bindings import BINDINGS, query

BINDINGS |= {
    "ec": """SELECT cell_id, gene_id, string_agg_sorted AS paths_key, mass FROM (SELECT cell_id, gene_id,
        PATHSET(path_id) AS string_agg_sorted, count(DISTINCT umi) AS mass FROM {molecules} WHERE qc_pass GROUP BY 1, 2) x""",
    "axis": "SELECT gene_id, PATHSET(path_id) AS axis_key, count(*) AS n_legal FROM {paths} GROUP BY 1",
}


@query("q1_unique", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q1(lineitem):
    return contracts.duplicates(lineitem, ["l_orderkey", "l_linenumber"])


@query("q2_foreign_key", "customer orders", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q2(customer, orders):
    return contracts.missing_parents(customer, orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("q3_set_equal", "lineitem", """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'N')
SELECT l_partkey, 'missing' AS side FROM a WHERE l_partkey NOT IN (SELECT l_partkey FROM b) UNION ALL SELECT l_partkey, 'extra' FROM b WHERE l_partkey NOT IN (SELECT l_partkey FROM a)""")
def q3(lineitem):
    return contracts.set_difference(lineitem.where("l_returnflag = 'A'"), lineitem.where("l_returnflag = 'N'"), ["l_partkey"])


@query("q4_levels", "events", "SELECT event_type AS level, count(*) AS rows FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def q4(events):
    return contracts.bad_levels(events, "event_type", ["click", "view"])


@query("q5_numeric", "customer", """SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal <> floor(c_acctbal) THEN 'fractional' END) AS reasons
FROM customer WHERE c_acctbal < 0 OR c_acctbal <> floor(c_acctbal)""")
def q5(customer):
    return contracts.bad_numbers(customer, ["c_custkey"], "c_acctbal", integer=True)


@query("q6_constant_within", "orders", """SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_o_orderstatus, count(DISTINCT o_orderpriority) AS n_o_orderpriority FROM orders
GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def q6(orders):
    return contracts.varying(orders, ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("q7_matched_scope", "typed_counts", """WITH g AS (SELECT path_id, count(DISTINCT cell_type) AS n_groups, count(DISTINCT n) AS n_values FROM {typed_counts} GROUP BY 1)
SELECT path_id, n_groups, n_values FROM g WHERE n_values > 1 OR n_groups <> (SELECT count(DISTINCT cell_type) FROM {typed_counts})""")
def q7(counts):
    return contracts.unmatched_scope(counts, "cell_type", ["path_id"], ["n"])


@query("q8_conserved", "molecules", """SELECT library_id, CAST(sum(n) AS BIGINT) AS whole, CAST(sum(CASE WHEN qc_pass THEN n ELSE 0 END + CASE WHEN NOT qc_pass THEN n ELSE 0 END) AS BIGINT) AS parts,
CAST(0 AS BIGINT) AS rows_off, true AS holds FROM {molecules} GROUP BY 1""")
def q8(molecules):
    own = F.when(F.col("qc_pass"), F.col("n")).otherwise(0)
    return contracts.conserved(molecules, F.col("n"), [own, F.when(~F.col("qc_pass"), F.col("n")).otherwise(0)], ["library_id"])


@query("q9_ec_rows", "ec axis", """SELECT cell_id, e.gene_id, paths_key, concat_ws(',', CASE WHEN mass % 2 = 0 THEN 'fate_differs' END) AS reasons FROM
(SELECT * FROM {ec}) e JOIN {axis} a ON a.gene_id = e.gene_id WHERE mass % 2 = 0""")
def q9(ec, axis):
    legal = axis.select("gene_id", F.split("axis_key", ";").alias("axis"), "n_legal")
    n = F.size(F.split("paths_key", ";"))
    right = F.when(n == F.col("n_legal"), "full").otherwise("informative")
    rows = ec.join(axis.select("gene_id", "n_legal"), "gene_id").withColumn("paths", F.split("paths_key", ";")).withColumn("fate", F.when(F.col("mass") % 2 == 0, "unheard_of").otherwise(right)).drop("n_legal")
    return contracts.ec_violations(rows, legal.drop("n_legal")).where("reasons <> ''").select("cell_id", "gene_id", "paths_key", "reasons")


@query("q13_rebind_split", "ec cell_split", "SELECT e.cell_id, e.gene_id, s.split FROM {ec} e LEFT JOIN {cell_split} s ON s.cell_id = e.cell_id")
def q13(ec, split):
    return contracts.rebound(ec.withColumn("split", F.lit("stale")), split).select("cell_id", "gene_id", "split")


@query("q14_canonical_order", "ec axis", """SELECT cell_id, e.gene_id, paths_key AS ordered, (SELECT string_agg(CAST(i - 1 AS VARCHAR), ';' ORDER BY i) FROM range(1, len(string_split(axis_key, ';')) + 1) r(i)
  WHERE list_contains(string_split(paths_key, ';'), string_split(axis_key, ';')[i])) AS places FROM {ec} e JOIN {axis} a ON a.gene_id = e.gene_id""")
def q14(ec, axis):
    reverse = F.reverse(F.split("paths_key", ";"))
    out = contracts.canonical_order(ec.withColumn("paths", reverse), axis.select("gene_id", F.split("axis_key", ";").alias("axis")))
    return out.select("cell_id", "gene_id", F.array_join("ordered", ";").alias("ordered"), F.array_join(F.transform("places", lambda i: i.cast("string")), ";").alias("places"))
