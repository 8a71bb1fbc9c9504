"""Routes of events to anchors: capping, normalisation, audits, gates and neutralisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import reasons, short_id
from .intervals import collapse_members

BUCKET = ["gene_id", "modality", "evidence", "anchor_id"]


def bucket_ranks(routes: DataFrame, bucket: list[str] = BUCKET) -> DataFrame:
    """Ranks of the events within each bucket (T1): open ones by support, calibrated ones by quality (DNA: then support),
    others by source rank and priority; then by proximity (0 with any overlap, else the least distance) and id."""
    near = F.min(F.when(F.col("relation") == "OVERLAP_ANCHOR", 0).otherwise(F.coalesce(F.abs("signed_distance"), F.least("d5", "d3"))))
    facts = ["support", "quality", "source_rank", "priority"]
    by = routes.groupBy(*bucket, "event_id").agg(near.alias("proximity"), *(F.first(c).alias(c) for c in facts))
    is_open, calibrated = F.col("evidence") == "open", F.col("evidence") == "calibrated"
    k1 = F.when(is_open, -F.col("support")).when(calibrated, -F.col("quality")).otherwise(F.col("source_rank").cast("double"))
    k2 = F.when(calibrated & (F.col("modality") == "DNA"), -F.col("support")).when(~is_open & ~calibrated, F.col("priority").cast("double")).otherwise(0.0)
    order = Window.partitionBy(*bucket).orderBy(k1, k2, "proximity", "event_id")
    return by.withColumn("rank", F.row_number().over(order)).withColumn("boundary", k1)


def cap_topk(routes: DataFrame, cap: int = 16, bucket: list[str] = BUCKET) -> DataFrame:
    """Routes of the first `cap` events of every bucket; all routes of a kept event stay."""
    kept = bucket_ranks(routes, bucket).where(F.col("rank") <= cap).select(*bucket, "event_id", "rank")
    return routes.join(kept, [*bucket, "event_id"])


def cap_audit(routes: DataFrame, cap: int = 16, bucket: list[str] = BUCKET) -> DataFrame:
    """Per bucket: candidates, selected, whether it is saturated, and the last selected one's first sort key."""
    r = bucket_ranks(routes, bucket)
    return r.groupBy(*bucket).agg(
        F.count("*").alias("candidates"), F.least(F.count("*"), F.lit(cap)).alias("selected"), (F.count("*") > cap).alias("saturated"),
        F.max(F.when(F.col("rank") == cap, F.col("boundary"))).alias("boundary"),
    )


def normalize_routes(routes: DataFrame) -> DataFrame:
    """Weight 1 / (routes of the event), so that an event's weights sum to 1."""
    return routes.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("event_id")))


def finalize_events(events: DataFrame, kept: DataFrame, gates: DataFrame) -> DataFrame:
    """Whether each event has a route and an active gate, whether it enters the model, and why not (T4)."""
    kinds = F.array_sort(F.collect_set("kind"))
    r = kept.groupBy("event_id").agg(F.count("*").alias("n_routes"), F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("MULTI_ANCHOR").alias("event_kind"))
    d = events.join(r, "event_id", "left").join(gates.select("event_id", "gate_active"), "event_id", "left")
    has, active = F.coalesce(F.col("n_routes") > 0, F.lit(False)), F.coalesce("gate_active", F.lit(False))
    why = F.array_join(reasons((~has, "no_route"), (~active, "gate_inactive")), ",")
    return d.select("event_id", "event_kind", has.alias("has_route"), active.alias("gate_active"), (has & active).alias("model_active"), why.alias("reasons"))


def degree_cap_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per event and anchor, what capping and renormalising did to its mass (T5).

    m_pre = anchor routes / all routes before; m_kept = kept anchor routes / all before; m_post = kept / all kept. Then
    m_post - m_pre = renorm_gain - cap_loss.
    """
    count = lambda d, keys, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    key = ["event_id", "anchor_id"]
    d = count(before, key, "a_pre").join(count(before, ["event_id"], "d_pre"), "event_id").join(count(after, key, "a_post"), key, "left").join(count(after, ["event_id"], "d_post"), "event_id", "left").fillna(0)
    pre, kept = F.col("a_pre") / F.col("d_pre"), F.col("a_post") / F.col("d_pre")
    post = F.when(F.col("d_post") > 0, F.col("a_post") / F.col("d_post")).otherwise(0.0)
    return d.withColumns({"m_pre": pre, "m_kept": kept, "m_post": post, "cap_loss": pre - kept, "renorm_gain": post - kept})


def event_gate_keys(events: DataFrame) -> DataFrame:
    """The gate of an event: RNA (gene, entity), open (gene, peak), DNA (gene, entity, peak)."""
    parts = F.when(F.col("modality") == "RNA", F.array("gene_id", "entity_id")).when(F.col("modality") == "OPEN", F.array("gene_id", "peak_id")).otherwise(F.array("gene_id", "entity_id", "peak_id"))
    return events.withColumn("gate_key_id", short_id("gate:", F.to_json(F.concat(F.array("modality"), parts))))


def gated_aggregate(routes: DataFrame, gates: DataFrame) -> DataFrame:
    """Sum of gate * weight * feature by cell, edge and column (T7). routes: gate_key_id, edge_id, column, weight, feature."""
    pre = routes.groupBy("gate_key_id", "edge_id", "column").agg(F.sum(F.col("weight") * F.col("feature")).alias("v"))
    return pre.join(gates, "gate_key_id").groupBy("cell_id", "edge_id", "column").agg(F.sum(F.col("gate") * F.col("v")).alias("value"))


def injection_signatures(routes: DataFrame) -> DataFrame:
    """(gene_id, modality, gate_key_id, event_id, group_id): events of one group_id inject exactly the same.

    The signature has the sum of weight * feature per edge and column, without zeros. A sum is added up in the order of
    its route ids, so that it has the same bits for every partitioning, and is compared bit by bit, never rounded. An
    event's routes on one edge are few, since capping bounds them.
    """
    term = F.struct("route_id", (F.col("weight") * F.col("feature")).alias("v"))
    total = F.aggregate(F.array_sort(F.collect_list(term)), F.lit(0.0), lambda a, x: a + x.v)
    key = ["gene_id", "modality", "gate_key_id", "event_id"]
    per = routes.groupBy(*key, "edge_id", "column").agg(total.alias("v"))
    # %a writes a double's bits; columns whose terms cancel are absent
    part = F.when(F.col("v") != 0, F.struct("edge_id", "column", F.format_string("%a", "v").alias("v")))
    sig = per.groupBy(*key).agg(F.to_json(F.array_sort(F.collect_list(part))).alias("sig"))
    return sig.select(*key, short_id("inj:", F.to_json(F.struct(*key[:3], "sig"))).alias("group_id"))


def injection_equivalence(signatures: DataFrame, events: DataFrame, least: int = 1, share: float = 0.0, strict: bool = True) -> DataFrame:
    """Groups of events with equal signatures: size, relations of their members, and how they are attributed.

    events: event_id, chrom, s, e, strand, factor, family, peak, open. `footprint` is identical (one interval),
    overlapping (every two members of it share a position: on a line that is so if all of them do) or mixed; `families`
    is open_only, mixed, same or distinct. Members that collapsing by these thresholds should have joined are an error,
    or with strict=False a flag. Members are the rows of `signatures`; no list of them is gathered.
    """
    same = ["group_id", "factor", "family", "chrom", "strand", "peak"]
    d = signatures.join(events, "event_id")
    hits = d.select(*same, F.col("event_id").alias("hit_id"), "s", "e").where(~F.col("open"))
    joined = collapse_members(hits, same, least, share).groupBy("group_id", "component").agg(F.count("*").alias("n"))
    joined = joined.where("n > 1").select("group_id").distinct().withColumn("should_have_collapsed", F.lit(True))
    one = lambda *cs: F.min(F.struct(*cs)) == F.max(F.struct(*cs))
    footprint = F.when(one("chrom", "s", "e", "strand"), "identical").when(one("chrom", "strand") & (F.max("s") < F.min("e")), "overlapping").otherwise("mixed")
    families = F.when(F.bool_and("open"), "open_only").when(F.bool_or("open"), "mixed").when(one("family"), "same").otherwise("distinct")
    out = d.groupBy("group_id", "gene_id", "modality", "gate_key_id").agg(F.min("event_id").alias("representative"), F.count("*").alias("events"), footprint.alias("footprint"), families.alias("families"))
    out = out.join(joined, "group_id", "left").withColumn("should_have_collapsed", F.coalesce("should_have_collapsed", F.lit(False)))
    if strict:
        out = out.withColumn("should_have_collapsed", F.when(F.col("should_have_collapsed"), F.raise_error(F.concat(F.lit("events that should have collapsed in "), "group_id")).cast("boolean")).otherwise(False))
    return out.withColumn("policy", F.when(F.col("events") == 1, "single_event").otherwise("exact_set"))


def selected_routes(routes: DataFrame, kind: str, value, groups: DataFrame | None = None) -> DataFrame:
    """Routes of a selector (T9): an event, factor, anchor, or the members of a group (groups: group_id, event_id)."""
    if kind == "group":
        return routes.join(groups.where(F.col("group_id") == value), "event_id", "left_semi")
    column = {"event": "event_id", "factor": "entity_id", "anchor": "anchor_id"}[kind]
    return routes.where(F.col(column) == value)


def routes_of_set(routes: DataFrame, sets: DataFrame, value) -> DataFrame:
    """Routes of the gates in a correlated set (T9). sets: set_id, gate_key_id."""
    return routes.join(sets.where(F.col("set_id") == value), "gate_key_id", "left_semi")


def selector_coverage(routes: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group of events: its members, those with routes left, its routes, and coverage full, partial or none."""
    own = routes.groupBy("event_id").agg(F.count("*").alias("n"))
    d = groups.select("group_id", "event_id").distinct().join(own, "event_id", "left")
    by = d.groupBy("group_id").agg(F.count("*").alias("members"), F.count("n").alias("routed"), F.coalesce(F.sum("n"), F.lit(0)).alias("routes"))
    return by.withColumn("coverage", F.when(F.col("routed") == 0, "none").when(F.col("routed") < F.col("members"), "partial").otherwise("full"))


def neutralize(routes: DataFrame, gates: DataFrame, selected: DataFrame) -> DataFrame:
    """The gated aggregate without the selected routes, not renormalised, and the change."""
    full = gated_aggregate(routes, gates)
    rest = gated_aggregate(routes.join(selected.select("route_id"), "route_id", "left_anti"), gates).withColumnRenamed("value", "kept")
    d = full.join(rest, ["cell_id", "edge_id", "column"], "left").fillna({"kept": 0.0})
    return d.withColumn("delta", F.col("kept") - F.col("value"))


def route_burden(routes: DataFrame) -> DataFrame:
    """Per edge: events, gates, anchors, sum of |weight| and the root of summed squared gate weights."""
    gate = routes.groupBy("edge_id", "gate_key_id").agg(F.sum("weight").alias("w")).groupBy("edge_id").agg(F.sqrt(F.sum(F.pow("w", F.lit(2)))).alias("b_gate"))
    by = routes.groupBy("edge_id").agg(F.count_distinct("event_id").alias("events"), F.count_distinct("gate_key_id").alias("gates"), F.count_distinct("anchor_id").alias("anchors"), F.sum(F.abs("weight")).alias("abs_weight"))
    return by.join(gate, "edge_id")


def burden_by_token(burden: DataFrame, tokens: DataFrame) -> DataFrame:
    """Burdens rolled up over edges for every token, zeros and a status where it has no routes (A14). tokens: token_id, edge_id."""
    d = tokens.join(burden, "edge_id", "left")
    out = d.groupBy("token_id").agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.sqrt(F.coalesce(F.sum(F.pow("b_gate", F.lit(2))), F.lit(0.0))).alias("b_gate"))
    return out.withColumn("status", F.when(F.col("events") > 0, "routed").otherwise("no_routes_on_token"))


def distance_bin(distance: Column, bounds: list[int]) -> Column:
    """Left-closed bins of |distance| with the label of both bounds; NULL is NA."""
    x, out = F.abs(distance), F.when(distance.isNull(), "NA")
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        out = out.when((x >= lo) & (x < hi), f"[{lo},{hi})")
    return out.otherwise(f"[{bounds[-1]},inf]")
