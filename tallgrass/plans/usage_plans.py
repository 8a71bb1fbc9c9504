"""Queries of differential usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage
from .bindings import BINDINGS, query

SHARES = """
shares AS (SELECT g.gene_id, g.cell_type, p.path_id, coalesce(t.n, 0) AS n, coalesce(t.n, 0) / CAST(g.total AS DOUBLE) AS psi
  FROM (SELECT gene_id, cell_type, sum(n) AS total FROM {typed_counts} GROUP BY 1, 2 HAVING sum(n) > 0) g
  JOIN {paths} p ON p.gene_id = g.gene_id
  LEFT JOIN {typed_counts} t ON t.gene_id = g.gene_id AND t.cell_type = g.cell_type AND t.path_id = p.path_id),
k AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS k, sum(psi) OVER (PARTITION BY path_id) AS s FROM shares),
js AS (SELECT gene_id, path_id, CASE WHEN max(k) < 2 THEN NULL WHEN max(s) = 0 THEN 0 ELSE greatest(0, sum(
    CASE WHEN psi > 0 THEN psi / s * log2(psi / s / ((psi / s + 1.0 / k) / 2)) ELSE 0 END
    + 1.0 / k * log2(1.0 / k / ((CASE WHEN s > 0 THEN psi / s ELSE 0 END + 1.0 / k) / 2))) / 2) END AS js FROM k GROUP BY 1, 2),
top AS (SELECT *, max(psi) OVER (PARTITION BY gene_id, cell_type) AS top FROM shares),
tied AS (SELECT *, CASE WHEN psi >= top - 1e-9 THEN 1 ELSE 0 END AS tied FROM top),
dom AS (SELECT gene_id, path_id, sum(each) AS dominated FROM (SELECT *, CASE WHEN tied = 1 THEN 1.0 / sum(tied) OVER (PARTITION BY gene_id, cell_type) ELSE 0 END AS each FROM tied) x GROUP BY 1, 2),
q AS (SELECT js.gene_id, js.path_id, js, dominated, dominated / sum(dominated) OVER (PARTITION BY js.gene_id) AS prop
  FROM js JOIN dom ON js.path_id = dom.path_id WHERE dominated >= 1 - 1e-9),
score AS (SELECT gene_id, count(*) AS nq, sum(-js * prop * log2(prop)) AS raw FROM q GROUP BY 1),
types AS (SELECT gene_id, count(DISTINCT cell_type) AS types, count(DISTINCT path_id) AS paths FROM shares GROUP BY 1),
dtu AS (SELECT t.gene_id, coalesce(nq, 0) AS n_qualified, CASE WHEN types < 2 THEN NULL WHEN coalesce(nq, 0) <= 1 THEN 0 ELSE raw END AS dtu
  FROM types t LEFT JOIN score s ON t.gene_id = s.gene_id WHERE paths >= 2)
"""


@query("d1_psi", "typed_counts", """SELECT cell_type, gene_id, path_id, n, round(n / CAST(sum(n) OVER (PARTITION BY gene_id, cell_type) AS DOUBLE), 6) AS psi FROM {typed_counts}""")
def d1(counts):
    return usage.psi(counts).select("cell_type", "gene_id", "path_id", "n", F.round("psi", 6).alias("psi"))


@query("d2_js_vs_uniform", "typed_counts paths", f"WITH {SHARES} SELECT gene_id, path_id, round(js, 6) AS js FROM js")
def d2(counts, paths):
    return usage.js_vs_uniform(usage.full_psi(counts, paths)).select("gene_id", "path_id", F.round("js", 6).alias("js"))


@query("d3_dominant_share", "typed_counts paths", f"WITH {SHARES} SELECT gene_id, path_id, round(dominated, 6) AS dominated, dominated >= 1 - 1e-9 AS qualified FROM dom")
def d3(counts, paths):
    return usage.dominant_share(usage.full_psi(counts, paths)).select("gene_id", "path_id", F.round("dominated", 6).alias("dominated"), "qualified")


@query("d4_dtu_score", "typed_counts paths", f"WITH {SHARES} SELECT gene_id, n_qualified, round(dtu, 6) AS dtu FROM dtu")
def d4(counts, paths):
    return usage.dtu_score(counts, paths).select("gene_id", "n_qualified", F.round("dtu", 6).alias("dtu"))


BINDINGS["train_counts"] = """SELECT c_nationkey AS cell_type, gene_id, path_id, CAST(sum(n) AS BIGINT) AS n FROM {counts} x JOIN {customer} ON x.cell_id = c_custkey
    JOIN {cell_split} s ON s.cell_id = c_custkey WHERE split = 'train' GROUP BY 1, 2, 3"""


@query("d5_dtu_two_scopes", "typed_counts train_counts paths", f"""SELECT coalesce(a.gene_id, b.gene_id) AS gene_id, round(a.dtu, 6) AS dtu_all, round(b.dtu, 6) AS dtu_train FROM (WITH {SHARES} SELECT gene_id, dtu FROM dtu) a
FULL JOIN (WITH {SHARES.replace("{typed_counts}", "{train_counts}")} SELECT gene_id, dtu FROM dtu) b ON b.gene_id = a.gene_id""")
def d5(typed, train, paths):
    out = usage.dtu_two_scopes(typed, train, paths)
    return out.select("gene_id", F.round("dtu_all", 6).alias("dtu_all"), F.round("dtu_train", 6).alias("dtu_train"))


@query("d6_dtu_table", "typed_counts paths", f"""WITH {SHARES},
mt AS (SELECT gene_id, avg(top) AS m FROM (SELECT DISTINCT gene_id, cell_type, top FROM top) x GROUP BY 1)
SELECT j.gene_id, count(*) AS n_paths, round(avg(js), 6) AS mean_js, round(sum(js), 6) AS sum_js,
  coalesce(string_agg(CASE WHEN dominated >= 1 - 1e-9 THEN printf('%s:%.4f', j.path_id, dominated) END, ',' ORDER BY j.path_id), '') AS distribution,
  round(max(m), 6) AS mean_top_psi, round(max(dtu), 6) AS dtu
FROM js j JOIN dom d ON j.path_id = d.path_id JOIN mt ON mt.gene_id = j.gene_id JOIN dtu ON dtu.gene_id = j.gene_id GROUP BY 1""")
def d6(counts, paths):
    return usage.dtu_table(counts, paths).select("gene_id", "n_paths", *(F.round(c, 6).alias(c) for c in ("mean_js", "sum_js")), "distribution", *(F.round(c, 6).alias(c) for c in ("mean_top_psi", "dtu")))
