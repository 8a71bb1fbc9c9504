import hashlib
import math
import random

import pytest

from tallgrass.llm import clusters, queries
from tests.oracle import differs

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def expected(rows, k, rounds, dims, scale=256, seed=2):
    """Lloyd's rounds, plainly."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if step < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = [0] * len(centroids)
    for (_, v), o in zip(kept, of, strict=True):
        inertia[o] += far(v, centroids[o])
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, far(v, centroids[o]), inertia[o], sum(inertia), digest[o]) for (i, v), o in zip(kept, of, strict=True)), key=str)


def vectors(seed, n, dims, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((rng.choice([i, 3]), [x + rng.gauss(0, spread) for x in c], 0, ""))
    rows += [rows[0]] * 40 + [(None, rows[1][1], 0, "")]
    rows += [(1, None, 0, ""), (2, [], 0, ""), (3, [1.0] * (dims + 1), 0, ""), (4, [math.nan] + [0.0] * (dims - 1), 0, ""), (5, [None] + [0.0] * (dims - 1), 0, ""), (6, [math.inf] * dims, 0, "")]
    return rows


def made(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "n", "dims", "k", "rounds", "spread"), [(1, 900, 4, 9, 5, 0.1), (2, 400, 64, 40, 5, 0.6), (3, 300, 3, 1, 4, 1), (4, 300, 2, 12, 8, 0.0)])
def test_clusters_equal_lloyds_rounds(spark, monkeypatch, seed, n, dims, k, rounds, spread):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    rows, scans = vectors(seed, n, dims, spread), []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(clusters.clustered(df, k=k, rounds=rounds, dims=dims, scans=scans)) == expected(rows, k, rounds, dims)
    if seed == 1:  # near clusters: bounds spare most scans
        assert scans[0] == len(rows) - 6 and scans[-1] < scans[0] / 4


def test_coarse_integers_have_ties_and_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-2, 2) / 256 for _ in range(3)], 0, "") for i in range(200)]
    assert made(clusters.clustered(spark.createDataFrame(rows, SCHEMA), k=10, dims=3)) == expected(rows, 10, 5, 3)
    rows = [(i, [rng.uniform(-200_000, 200_000) for _ in range(3)], 0, "") for i in range(100)]
    assert made(clusters.clustered(spark.createDataFrame(rows, SCHEMA), k=6, dims=3)) == expected(rows, 6, 5, 3)
    huge = [(1, [1e300, 0.0], 0, ""), (2, [-1e300, 0.0], 0, "")]
    assert [r[1:3] for r in made(clusters.clustered(spark.createDataFrame(huge, SCHEMA), k=1, dims=2))] == [(0, 2**54)] * 2


def test_few_vectors_and_none(spark):
    rows = vectors(8, 3, 4, 1)[:3]
    assert made(clusters.clustered(spark.createDataFrame(rows, SCHEMA), dims=4)) == expected(rows, 40, 5, 4)
    assert made(clusters.clustered(spark.createDataFrame([], SCHEMA), dims=4)) == []


def test_rounds_join_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 50)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        points = spark.createDataFrame(vectors(1, 300, 4, 1)[:300], SCHEMA).selectExpr("vec_id AS id", "transform(embedding, x -> bigint(x)) AS x")
        fixed, a = clusters.bucketed(clusters.blocks(points).repartition(4, "block"), 4, "blocks")
        state, b = clusters.bucketed(fixed.select("block"), 4, "bounds")
        plan = fixed.join(state, "block")._jdf.queryExecution().executedPlan().toString()
        spark.sql(f"DROP TABLE {a}")
        spark.sql(f"DROP TABLE {b}")
        assert "Join" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_the_query_equals_its_sql(spark):
    assert differs(spark, "/root/testdata/sf0.01", queries.QUERIES["op12_clusters"], queries.ORACLES["op12_clusters"]) == ""
