"""Rows are dealt to many tasks before they are multiplied, written or judged, and no task holds all of a few keys."""

import glob

from pyspark.sql import functions as F

from tallgrass.operators import audit, identify, metrics, reports
from tallgrass.plans import bindings, report_plans  # noqa: F401
from tallgrass.sources import tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_signs_are_drawn_in_many_tasks(spark, tmp_path):
    """Customers of one file are dealt anew before each has 300 signs."""
    spark.range(40).selectExpr("id AS c_custkey", "CAST(id AS double) AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    cents = bindings.bind(spark, str(tmp_path), "cents")
    assert cents.rdd.getNumPartitions() == 4
    assert sorted(r.cents for r in cents.collect()) == [100 * i for i in range(40)]


def test_draws_are_dealt_and_not_sorted(spark):
    """Draws are made in many tasks and meet their values without a sort."""
    d = spark.range(30).selectExpr("id AS i", "CAST(id AS double) AS x").coalesce(1)
    out = reports.bootstrap_ci(d, "x", 200, 5)
    assert "RoundRobinPartitioning(4)" in plan_of(out) and "SortMergeJoin" not in plan_of(out)
    r = out.first()
    assert r.lo < r["mean"] == 14.5 < r.hi


def test_a_value_of_many_rows_has_several_files(spark, tmp_path):
    """Partition values are dealt by ranges of their keys."""
    d = spark.range(4000).selectExpr("CASE WHEN id % 20 = 0 THEN 'b' ELSE 'a' END AS v", "(id * 7919) % 4000 AS k")
    tables.write_dataset(d, f"{tmp_path}/out", "v", ["k"])
    files = glob.glob(f"{tmp_path}/out/v=a/*.parquet")
    assert len(files) >= 3
    for f in files:
        keys = [r.k for r in spark.read.parquet(f).collect()]
        assert keys == sorted(keys)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("v", "k").collect())) == sorted(map(tuple, d.collect()))


def test_rows_are_not_dealt_by_strata(spark):
    """The means of strata come to the rows, however large their tables are thought to be."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = spark.range(100).selectExpr("id % 2 AS s", "CAST(id AS double) AS y", "id + 0.5 AS p", "1.0D AS w")
        out = audit.weighted_r2(d, ["s"], "y", "p", "w")
        assert "SortMergeJoin" not in plan_of(out)
        assert [r.s for r in out.orderBy("s").collect()] == [0, 1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_relative_log_mass_holds_no_table(spark):
    """Each row is worked out by itself: no aggregate over cells and genes."""
    rows = [(c, "g", [(f"{x}{c}", float(c + i)) for i, x in enumerate("AEB")]) for c in range(3)] + [(9, "g", [("B", 1.0), ("E", 800.0)])]
    sets = spark.createDataFrame(rows, "cell_id long, gene_id string, logits array<struct<path_id:string,logit:double>>")
    out = metrics.relative_log_mass(sets, lambda p: p.contains("E"), lambda p: p.contains("A"))
    assert "Aggregate" not in plan_of(out)
    got = {r.cell_id: r.relative_log_mass for r in out.collect()}
    assert got.pop(9) is None and all(abs(v - 1) < 1e-12 for v in got.values()) and len(got) == 3
    flat = metrics.relative_log_mass(sets.select("cell_id", "gene_id", F.inline("logits")), lambda p: p.contains("E"), lambda p: p.contains("A"))
    assert sorted(map(str, flat.collect())) == sorted(map(str, out.collect()))


def test_masses_meet_their_cells_before_the_pairs(spark):
    """Rows of cells and contrasts are not shuffled for the masses of either side."""
    cells = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h")], "cell_id long, gene_id string")
    pairs = spark.createDataFrame([("g", "c", "x", "y"), ("g", "c", "x", "z"), ("h", "c", "x", "y")], "gene_id string, choice_id string, a string, b string")
    mass = spark.createDataFrame([(1, "g", "x", 4), (1, "g", "z", 2), (3, "h", None, 7)], "cell_id long, gene_id string, alternative_id string, mass long")
    out = identify.heldout_contrast_support(cells, pairs, mass)
    assert plan_of(out).count("SortMergeJoin") + plan_of(out).count("BroadcastHashJoin") == 2
    got = sorted((r.cell_id, r.a, r.b, r.mass_a, r.mass_b, r.tier) for r in out.collect())
    assert got == [(1, "x", "y", 4, 0, "one"), (1, "x", "z", 4, 2, "both"), (2, "x", "y", 0, 0, "none"), (2, "x", "z", 0, 0, "none"), (3, "x", "y", 0, 0, "none")]
