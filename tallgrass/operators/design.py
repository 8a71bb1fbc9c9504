"""Route design tables: context, vocabularies, encodings, Gram matrix and supported interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import guarded
from .routes import distance_bin


def route_context(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes with their events' facts, open ones under the factor OPEN_ONLY."""
    d = routes.join(events, "event_id")
    return d.withColumn("factor", F.coalesce("factor", F.lit("OPEN_ONLY")))


def binned_context(events: DataFrame, routes: DataFrame, bounds: list[int]) -> DataFrame:
    """Routes with their one event's facts and the bin of their distance (N2); a route without an event, or with several, is an error."""
    once = events.groupBy("event_id").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in events.columns if c != "event_id"))
    d = routes.join(once, "event_id", "left")
    fault = F.when(F.col("_n").isNull(), "a route has no event").when(F.col("_n") > 1, "a route has several events")
    return d.where(guarded(fault)).drop("_n").withColumns({"factor": F.coalesce("factor", F.lit("OPEN_ONLY")), "bin": distance_bin(F.col("distance"), bounds)})


def feature_manifest(context: DataFrame, fields: list[str]) -> DataFrame:
    """Frozen vocabularies: sorted levels of every field, the first being the reference, and their number."""
    long = context.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("level")) for f in fields))).alias("x")).select("x.*")
    by = long.where("level IS NOT NULL").groupBy("field").agg(F.array_sort(F.collect_set("level")).alias("levels"))
    return by.select("field", "levels", F.element_at("levels", 1).alias("reference"), F.size("levels").alias("n_levels"))


def encode_base(context: DataFrame, manifest: DataFrame, fields: list[str], numbers: list[str], full: str) -> DataFrame:
    """Sparse design (N4): one-hot of `full` with all levels, of other fields without their reference, log1p of numbers."""
    ref = F.broadcast(manifest.select("field", "reference"))
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("level")) for f in fields))
    hot = context.select("route_id", F.explode(parts).alias("x")).select("route_id", "x.*").where("level IS NOT NULL").join(ref, "field").where((F.col("field") == full) | (F.col("level") != F.col("reference")))
    hot = hot.select("route_id", F.concat_ws("=", "field", "level").alias("column"), F.lit(1.0).alias("value"))
    num = context.select("route_id", F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.log1p(F.abs(F.col(n).cast("double"))).alias("value")) for n in numbers))).alias("x"))
    return hot.unionByName(num.select("route_id", "x.*").where("value <> 0"))


def gram(design: DataFrame) -> DataFrame:
    """Upper triangle of X'X over the columns."""
    a = design.select("route_id", F.col("column").alias("c1"), F.col("value").alias("v1"))
    b = design.select("route_id", F.col("column").alias("c2"), F.col("value").alias("v2"))
    return a.join(b, "route_id").where("c1 <= c2").groupBy("c1", "c2").agg(F.sum(F.col("v1") * F.col("v2")).alias("value"))


def interaction_support(context: DataFrame, fields: list[str], mass: DataFrame, least_events: int, least_mass: float) -> DataFrame:
    """For every (field, factor, level) of the full grid: events, genes, mass and reasons against it.

    context: event_id, gene_id, factor, fields; mass: gene_id, mass.
    """
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("level")) for f in fields))
    long = context.select("event_id", "gene_id", "factor", F.explode(parts).alias("x")).select("event_id", "gene_id", "factor", "x.*").where("level IS NOT NULL")
    grid = long.select("factor").distinct().crossJoin(F.broadcast(long.select("field", "level").distinct()))  # vocabularies
    by = long.groupBy("field", "factor", "level").agg(F.count_distinct("event_id").alias("events"), F.count_distinct("gene_id").alias("genes"))
    m = long.select("field", "factor", "level", "gene_id").distinct().join(mass, "gene_id").groupBy("field", "factor", "level").agg(F.sum("mass").alias("mass"))
    d = grid.join(by, ["field", "factor", "level"], "left").join(m, ["field", "factor", "level"], "left").fillna({"events": 0, "genes": 0, "mass": 0})
    return d.withColumn("supported", (F.col("events") >= least_events) & (F.col("mass") >= least_mass))


def supported_rectangles(support: DataFrame) -> DataFrame:
    """Factor and level pairs of which all four corners are supported."""
    s = support.where("supported").select("field", "factor", "level")
    pair = s.join(s.select("field", F.col("factor").alias("factor2"), "level"), ["field", "level"]).where("factor < factor2")
    other = pair.select("field", "factor", "factor2", F.col("level").alias("level2"))
    return pair.join(other, ["field", "factor", "factor2"]).where("level < level2").select("field", "factor", "factor2", "level", "level2")


def cycle_space_dim(support: DataFrame) -> DataFrame:
    """E - V + C of the bipartite graph of factors and levels, isolated vertices included (N9), by field."""
    from ..streaming.components import components

    v = support.select("field", F.concat(F.lit("f:"), "factor").alias("v")).union(support.select("field", F.concat(F.lit("l:"), "level").alias("v"))).distinct()
    e = support.where("supported").select("field", F.concat_ws("|", "field", F.concat(F.lit("f:"), "factor")).alias("a"), F.concat_ws("|", "field", F.concat(F.lit("l:"), "level")).alias("b")).distinct()
    nodes = v.withColumn("node", F.concat_ws("|", "field", "v"))
    root = components(e.select("a", "b"))
    c = nodes.join(root, "node", "left").groupBy("field").agg(F.count("*").alias("vertices"), F.count_distinct(F.coalesce("root", "node")).alias("parts"))
    return c.join(e.groupBy("field").agg(F.count("*").alias("edges")), "field", "left").fillna({"edges": 0}).withColumn("dim", F.col("edges") - F.col("vertices") + F.col("parts"))


def interaction_claims(support: DataFrame) -> DataFrame:
    """Status of every pair of a factor's levels (N10): unsupported arm, within the factor only, or covered by a comparator."""
    s = support.select("field", "factor", "level", "supported")
    pairs = s.join(s.select("field", "factor", F.col("level").alias("level2"), F.col("supported").alias("supported2")), ["field", "factor"]).where("level < level2")
    rect = supported_rectangles(support)
    both = rect.select("field", "factor", F.col("factor2").alias("other"), "level", "level2").unionByName(rect.select("field", F.col("factor2").alias("factor"), F.col("factor").alias("other"), "level", "level2"))
    by = both.groupBy("field", "factor", "level", "level2").agg(F.count_distinct("other").alias("comparators"))
    d = pairs.join(by, ["field", "factor", "level", "level2"], "left").fillna({"comparators": 0})
    status = F.when(~(F.col("supported") & F.col("supported2")), "unsupported_arm").when(F.col("comparators") == 0, "within_factor_only").otherwise("four_corner_covered")
    return d.select("field", "factor", "level", "level2", "comparators", status.alias("status"))
