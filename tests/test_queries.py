"""Registered queries against their SQL on the smallest tables, and on repartitioned input."""

import os

import pytest

import __spark_entry__ as entry
from tallgrass.operators import audit, intervals
from tests.oracle import differs, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    assert differs(spark, SF, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))))
def test_runs_without_sql(spark, name):
    entry.queries()[name](spark, SF).collect()


def test_partitions_do_not_matter(spark):
    x = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey as k", "l_partkey as s", "l_partkey + cast(l_quantity as int) as e")
    a, b = (intervals.islands(x.repartition(n), ["k"]) for n in (1, 7))
    assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect())


def test_tiled_join_equals_nested_loops(spark):
    import random

    rng = random.Random(1)
    iv = lambda n: [(i, rng.randint(0, 3), s := rng.randint(-500, 500), s + rng.choice([0, 1, 5, 90, 400])) for i in range(n)]
    left, right = iv(150), iv(120)
    got = intervals.interval_join(spark.createDataFrame(left, "a int, g int, ls long, le long"), spark.createDataFrame(right, "b int, g int, rs long, re long"), ["g"], 37)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_waterfall_keeps_empty_strata(spark):
    ec = spark.createDataFrame([("a", "full", 3)], "g string, fate string, mass long")
    out = {(r.g, r.fate): (r.mass, r.fraction, r.status) for r in audit.fate_waterfall(ec, ["g"], ["full", "empty"], spark.createDataFrame([("a",), ("b",)], "g string")).collect()}
    assert out[("a", "full")] == (3, 1.0, "estimable") and out[("b", "empty")] == (0, None, "not_estimable")
