"""Collapsing hits by overlap thresholds (I9) against all pairs."""

import itertools
import random

import pytest

from tallgrass.operators import intervals

SCHEMA = "hit_id string, g int, s long, e long, quality double, local_rank long, priority int, motif_id string, valid boolean"


def components(hits, least, share):
    root = {h[0]: h[0] for h in hits}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(hits, 2):
        shared = min(a[3], b[3]) - max(a[2], b[2])
        if a[1] == b[1] and shared >= max(least, 1) and min(shared / (a[3] - a[2]), shared / (b[3] - b[2])) >= share:
            x, y = sorted((find(a[0]), find(b[0])))
            root[y] = x
    return {h[0]: find(h[0]) for h in hits}


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randint(0, 3000)
        length = rng.choice([1, 2, 4, 5, 8, 9, 16, 17, 30, 60, 250, 2000])
        rows.append((f"h{i:03}", rng.choice([0, 1, None]), s, s + length, rng.choice([None, float("nan"), 0.5, 1.5]), rng.randint(0, 4), rng.randint(0, 1), rng.choice("AB"), rng.random() < 0.9))
    return rows + [(f"k{r[0]}", *r[1:]) for r in rows[:20]]


@pytest.mark.parametrize(("least", "share"), [(1, 0.0), (5, 0.0), (1, 0.5), (5, 0.5), (1, 1.0), (3, 0.05), (2, 0.9)])
def test_components_equal_all_pairs(spark, least, share):
    rows = made(260, int(least * 10 + share * 100))
    got = intervals.collapse_members(spark.createDataFrame(rows, SCHEMA), ["g"], least, share).collect()
    want = components(rows, least, share)
    assert len(got) == len(rows) and {r.hit_id: r.component for r in got} == want


def test_representative_and_event(spark):
    rows = [
        ("b", 1, 0, 10, 0.2, 1, 0, "M2", True), ("a", 1, 5, 15, 0.9, 9, 0, "M1", True), ("c", 1, 14, 24, None, 0, 0, "M1", False),
        ("e", 1, 100, 110, None, 3, 1, "M1", True), ("d", 1, 101, 111, None, 3, 0, "M3", True), ("f", 2, 0, 10, None, 1, 0, "M1", True),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.representative: r for r in intervals.collapse_hits(intervals.collapse_members(df, ["g"]), ["g"]).collect()}
    assert {k: (r.s, r.e, r.from_s, r.to_e, r.n_hits, r.n_motifs, r.valid) for k, r in got.items()} == {
        "a": (5, 15, 0, 24, 3, 2, False), "d": (101, 111, 100, 111, 2, 2, True), "f": (0, 10, 0, 10, 1, 1, True),
    }
    assert len({r.event_id for r in got.values()}) == 3 and all(r.event_id.startswith("event:") for r in got.values())


def test_minimum_overlap_and_share_of_the_contract(spark):
    rows = [("M1", "fam", 100, 108), ("M2", "fam", 106, 114), ("M3", "fam", 112, 120), ("O", "other", 104, 112)]
    df = spark.createDataFrame(rows, "hit_id string, g string, s long, e long")
    got = {r.hit_id: r.component for r in intervals.collapse_members(df, ["g"], 2, 0.2).collect()}
    assert got == {"M1": "M1", "M2": "M1", "M3": "M1", "O": "O"}


def test_long_hits_over_many_tiles_meet_only_their_like(spark):
    rows = [(f"s{i:03}", 1, 10 * i, 10 * i + 8, 1.0, 1, 0, "A", True) for i in range(100)]
    rows += [("x", 1, 0, 1000, 1.0, 1, 0, "A", True), ("y", 1, 300, 1299, 1.0, 1, 0, "A", True), ("z", 1, 800, 1799, 1.0, 1, 0, "A", True)]
    links = intervals.overlap_links(spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"hit_id": "node", "g": "bucket"}), 1, 0.5)
    assert [tuple(r) for r in links.collect()] == [("x", "y")]


@pytest.mark.parametrize("row", [("a", 1, 5, 5), ("a", 1, -1, 5), ("a", 1, None, 5)])
def test_broken_intervals_and_thresholds_are_errors(spark, row):
    df = spark.createDataFrame([row], "hit_id string, g int, s long, e long")
    with pytest.raises(Exception, match="half-open"):
        intervals.collapse_members(df, ["g"]).collect()
    with pytest.raises(ValueError, match="least"):
        intervals.collapse_members(df, ["g"], 0)
    bare = spark.createDataFrame([("a", 1, 1, 5, None, None, 0, "A", True)], SCHEMA)
    with pytest.raises(Exception, match="quality or a local rank"):
        intervals.collapse_hits(intervals.collapse_members(bare, ["g"]), ["g"]).collect()
