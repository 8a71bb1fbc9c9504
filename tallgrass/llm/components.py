"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved


def stars(links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root): every linked node but the roots, with the least node of its component.

    links has two columns a and b of one orderable type; null ends, loops and repeats are ignored. Each round is a
    few shuffles of the links and is written to the shared folder; rounds grow with the logarithm of the longest chain.
    It ends when a round changes nothing; were tasks that ran twice counted twice, it would go on for one round more.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = _counted(e, name)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _counted(least.select("u", F.col("m").alias("v")).unionByName(small).distinct(), name)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


def _counted(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The links, written, with their number and a sum of their hashes, both observed while they are written."""
    seen = Observation()
    e = saved(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return e, (seen.get["n"], seen.get["h"])
