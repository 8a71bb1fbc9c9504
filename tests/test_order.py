"""Sums whose last bit decides a comparison do not hang on the order in which rows arrive."""

import math
import random

import __spark_entry__ as entry
from tallgrass.plans import bindings


def test_equal_users_tie_at_every_quantile(spark, tmp_path):
    """Users with the same events, in files and tasks of any order, have the same bits and equal counts of unusual gates."""
    rng = random.Random(3)
    values = [[round(rng.expovariate(1 / 50), 2) for _ in range(40)] for _ in range(20)]
    kinds = [["view", "click", "buy"][rng.randrange(3)] for _ in range(40)]
    rows = [(1000 * u + i, u, kinds[i - u % 5], v) for u in range(400) for i, v in enumerate(values[u % 20])]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = bindings.bind(spark, str(tmp_path), "access").collect()
    assert len(got) == 1600
    for r in got:
        total = 0.0
        for v in values[r.cell_id % 20][r.peak_id :: 4]:
            total += v
        assert abs(r.access - math.log(1 + total)) < 1e-14
    assert len({r.access for r in got}) == 80
    users = entry.queries()["x12_gate_pipeline"](spark, str(tmp_path)).collect()
    assert len(users) == 400 and len({(r.cell_id % 20, r.unusual) for r in users}) == 20


def test_sums_in_order_leave_out_what_is_missing(spark):
    from tallgrass.functions.core import ordered_sum

    d = spark.createDataFrame([("a", 3, 0.3), ("a", 1, 0.1), ("a", 2, 0.2), ("a", 2, None), ("b", 1, None), (None, 1, 2.0), (None, 1, 2.0)], "k string, i int, x double")
    assert {r.k: r.x for r in ordered_sum(d, ["k"], "x", "i").collect()} == {"a": 0.1 + 0.2 + 0.3, "b": None, None: 4.0}
