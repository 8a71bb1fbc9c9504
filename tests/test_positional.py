"""The positional stream (ST1): late rows, repeats, restarts."""

import random

from tallgrass.sources.shared import folder
from tallgrass.streaming import positional as ps

COLUMNS = ["kind", "group_id", "member", "position", "n", "value"]


def streamed(spark, batches, shards=4):
    """Each batch is a run of its own on one checkpoint, in several files."""
    source, out, check = (folder(spark, "stream") for _ in range(3))
    frames = [spark.createDataFrame(b, ps.ROWS).repartition(2) for b in batches]
    for frame in frames:
        frame.write.mode("append").parquet(source)
        ps.run_available(ps.positional_aggregate(spark.readStream.schema(frame.schema).parquet(source), shards), out, check)
    raw = spark.read.schema(ps.OUT).parquet(out)
    return raw, sorted(map(tuple, ps.totals(raw).select(COLUMNS).collect()), key=str)


def test_stream_with_late_rows_and_repeats_equals_the_replay(spark):
    rng = random.Random(2)
    batches = []
    for k in range(4):
        rows = []
        for _ in range(120):
            at = 1000 * k + rng.randint(0, 1200)
            g = max(0, at - rng.choice([0, 0, 0, 300, 1500])) // 250
            rows.append((f"g{g}", f"m{rng.randint(0, 8)}", at, 250 * (g + 1) + 100, rng.randint(1, 9)))
        batches.append(rows)
    close = [("close", "", 10**7, 2 * 10**7, 0)]
    _, got = streamed(spark, [*batches, close])
    numbered = spark.createDataFrame([(*r, k) for k, b in enumerate(batches) for r in b], ps.ROWS + ", batch int")
    want = sorted(map(tuple, ps.replay(numbered).select(COLUMNS).collect()), key=str)
    assert got == want
    assert {r[0] for r in got} == {"group", "late", "repeated"}


def test_a_group_is_given_out_once_its_end_is_passed(spark):
    batches = [[("a", "x", 10, 100, 1), ("b", "x", 20, 500, 2)], [("b", "y", 99, 500, 3), ("c", "z", 100, 600, 4)], [("a", "late", 101, 100, 7), ("b", "x", 130, 500, 8)]]
    raw, got = streamed(spark, batches)
    # a's end is position 100, which the second batch reaches; b is still open at the end
    assert got == [("group", "a", None, 100, 1, 1), ("late", "a", "late", 101, 1, 7), ("repeated", "b", "x", 130, 1, 8)]


def test_shards_split_a_hot_group_and_change_nothing(spark):
    rows = [("hot", f"m{i % 90}", i, 1000, 1) for i in range(120)]
    close = [("close", "", 10**6, 2 * 10**6, 0)]
    one, a = streamed(spark, [rows, close], 1)
    many, b = streamed(spark, [rows, close], 8)
    assert a == b and a[0] == ("group", "hot", None, 1000, 90, 90) and len(a) == 31
    assert one.where("kind = 'group'").count() == 1 and many.where("kind = 'group'").count() == 8
