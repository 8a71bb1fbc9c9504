"""Correlated sets (X14): what chunks of links leave, and how members are joined."""

import random

from pyspark.sql import functions as F

from tallgrass.streaming import components as linked


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_hold_whole_stars(spark, monkeypatch):
    """Links in any order come to their chunk by first end: a hub is in few chunks, and few links between chunks are left."""
    monkeypatch.setattr(linked, "CHUNK", 30)
    links = [(f"h{h:02d}", f"n{h}-{i}") for h in range(40) for i in range(25)]
    random.Random(1).shuffle(links)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        edges = spark.createDataFrame(links, "a string, b string").repartition(3)
        assert linked.local_roots(edges).count() <= len(links) + 3 * 40
        got = {r.node: r.root for r in linked.components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {x: h for h, n in links for x in (h, n)}


def test_members_are_joined_where_they_lie(spark):
    """No task gathers the names of a set: texts of batches meet, in order, also of nodes that are numbers."""
    rng = random.Random(2)
    sets = {}
    for i in range(3000):
        sets.setdefault(0 if i % 2 else rng.randrange(1, 900), []).append(i)
    rows = [(i, min(x)) for x in sets.values() for i in x]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for kind, name in (("long", int), ("string", lambda i: f"n{i}")):
            d = spark.createDataFrame([(name(i), name(r)) for i, r in rows], f"node {kind}, root {kind}")
            out = linked.joined_members(d)
            assert "collect_set" not in plan_of(out) and "rangepartitioning(root" in plan_of(out)
            want = {name(min(x)): (",".join(map(str, sorted(map(name, x)))), len(x)) for x in sets.values()}
            assert {r.root: (r.members, r["size"]) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert linked.joined_members(d.limit(0)).collect() == []


def test_sets_and_their_edges_agree(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("x", "y"), ("z", "z"), (None, "a")], "gate_a string, gate_b string")
    sets = {r.members: (r.set_id, r["size"]) for r in linked.correlated_sets(pairs).collect()}
    assert {m: n for m, (_, n) in sets.items()} == {"a,b,c": 3, "x,y": 2}
    assert sets["x,y"][0] == "set:" + spark.range(1).select(F.sha2(F.lit("x,y"), 256)).first()[0][:24]
    edges = sorted(map(tuple, linked.set_edges(pairs).select("set_id", "gate_a", "gate_b").collect()))
    assert edges == sorted([(sets["a,b,c"][0], "a", "b"), (sets["a,b,c"][0], "b", "c"), (sets["x,y"][0], "x", "y")])
