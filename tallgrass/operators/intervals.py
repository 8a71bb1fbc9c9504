"""Half-open intervals: windows, overlaps, merging, tiled range joins, routing and collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import short_id, top_one
from ..streaming.components import components

IV = "array<struct<s:bigint,e:bigint>>"


def oriented_window(pos: Column, a: int, b: int, strand: Column) -> tuple[Column, Column]:
    """[pos + a, pos + b) on the + strand, mirrored on the other."""
    minus = strand == "-"
    return F.when(minus, pos - b).otherwise(pos + a), F.when(minus, pos - a).otherwise(pos + b)


def overlap_bp(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the overlap, at least 0."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def merge_array(intervals: Column) -> Column:
    """Union of an array of intervals; touching ones merge."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last.s.alias("s"), F.greatest(last.e, x.e).alias("e")))
        return F.when((F.size(acc) > 0) & (x.s <= F.try_element_at(acc, F.lit(-1)).e), joined).otherwise(F.array_append(acc, F.struct(x.s.alias("s"), x.e.alias("e"))))

    return F.aggregate(F.array_sort(intervals), F.array().cast(IV), step)


def merge_rows(df: DataFrame, keys: list[str], s: str = "s", e: str = "e", least: int = 0) -> DataFrame:
    """Islands of intervals that overlap by `least` positions or more (0: touching ones too), with rows per island.

    A running maximum of ends within the keys marks where an island starts; a second running sum numbers the islands.
    """
    w = Window.partitionBy(*keys).orderBy(s, e)
    before = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(s) > before - least)).cast("int")
    d = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.drop("_new")


def islands(df: DataFrame, keys: list[str], s: str = "s", e: str = "e", least: int = 0) -> DataFrame:
    return merge_rows(df, keys, s, e, least).groupBy(*keys, "island").agg(F.min(s).alias(s), F.max(e).alias(e), F.count("*").alias("members")).drop("island")


def subtract(intervals: Column, s: Column, e: Column) -> Column:
    """Removes [s, e) from every interval; empty rests go (I4)."""
    parts = F.flatten(F.transform(intervals, lambda x: F.array(F.struct(x.s.alias("s"), F.least(x.e, s).alias("e")), F.struct(F.greatest(x.s, e).alias("s"), x.e.alias("e")))))
    return F.filter(parts, lambda x: x.s < x.e)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], tile: int, how: str = "overlap") -> DataFrame:
    """Pairs of overlapping intervals with equal keys (I6). Columns ls, le on the left and rs, re on the right.

    Both sides are dealt to tiles of `tile` positions and joined on keys and tile; a pair is taken in the tile where the
    later of the two begins, so that no pair comes twice and no distinct is needed. The join is an equi-join that Spark
    can sort, split where skewed, and spill.
    """
    tiles = lambda d, s, e: d.withColumn("_tile", F.explode(F.sequence(F.floor(F.col(s) / tile), F.floor((F.col(e) - 1) / tile))))
    both = tiles(left.where("ls < le"), "ls", "le").join(tiles(right.where("rs < re"), "rs", "re"), [*keys, "_tile"])
    return both.where((F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")) & (F.col("_tile") == F.floor(F.greatest("ls", "rs") / tile))).drop("_tile")


def route_events(events: DataFrame, anchors: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Routes events to anchors (I7). events: event_id, ls, le; anchors: anchor_id, rs, re, kind (site or edge), strand.

    A site takes every event that overlaps it: OVERLAP_ANCHOR with no distance where the event lies within, else the
    signed distance of the centres, flipped on the - strand, UPSTREAM below 0. An edge takes events centred in it, with
    the distances to both of its ends and the relative place.
    """
    d = interval_join(events, anchors, keys, tile)
    centre, middle = F.floor((F.col("ls") + F.col("le")) / 2), F.floor((F.col("rs") + F.col("re")) / 2)
    inside = (F.col("ls") >= F.col("rs")) & (F.col("le") <= F.col("re"))
    site, sign = F.col("kind") == "site", F.when(F.col("strand") == "-", -1).otherwise(1)
    signed = F.when(site & ~inside, (centre - middle) * sign)
    place = F.when(~site, F.lit("IN_EDGE")).when(inside, "OVERLAP_ANCHOR").when(signed < 0, "UPSTREAM").otherwise("DOWNSTREAM")
    d = d.where(site | ((centre >= F.col("rs")) & (centre < F.col("re"))))
    d5 = F.when(~site, F.when(F.col("strand") == "-", F.col("re") - 1 - centre).otherwise(centre - F.col("rs")))
    d3 = F.when(~site, F.col("re") - F.col("rs") - 1 - d5)
    out = d.withColumns({"relation": place, "signed_distance": signed, "d5": d5, "d3": d3})
    return out.withColumn("route_id", short_id("route:", F.concat_ws("|", *(F.col(c).cast("string") for c in ("event_id", "anchor_id")))))


def unique_owner(hits: DataFrame, same: list[str]) -> DataFrame:
    """Of equal hits the one of most support, then least peak and id; all peaks stay as a sorted list (I8)."""
    peaks = hits.groupBy(*same).agg(F.array_join(F.array_sort(F.collect_set("peak_id")), ",").alias("peaks"), F.count("*").alias("n_hits"))
    return top_one(hits, same, F.col("support").desc(), "peak_id", "hit_id").join(peaks, same)


def collapse_overlaps(hits: DataFrame, bucket: list[str]) -> DataFrame:
    """Connected components of overlapping hits in a bucket, with the best as representative (I9; one position is enough)."""
    own = merge_rows(hits, bucket, "s", "e", 1)
    keys = [*bucket, "island"]
    span = own.groupBy(*keys).agg(F.min("s").alias("from_s"), F.max("e").alias("to_e"), F.count("*").alias("n_hits"))
    best = top_one(own, keys, F.col("quality").desc(), "hit_id").select(*keys, F.col("hit_id").alias("representative"))
    return span.join(best, keys).drop("island")


def overlap_links(spots: DataFrame, least: int, share: float) -> DataFrame:
    """Pairs (a, b) of nodes in a bucket that overlap by `least` positions and by `share` (above 0) of the longer one.

    spots: node, bucket, s, e. Linked intervals are alike in length, so they are dealt to levels of lengths, a
    factor of 1 / share apart, and within a level to tiles as wide as its intervals: a pair is sought on the level of its
    shorter one, in the tile where the later one begins. Short intervals never meet the tiles of long ones, and a long
    one has as few tiles as a short one. The join is an equi-join that Spark can split where a tile is hot.
    """
    base = 1.001 / share  # a little more, so that rounding can't put a linked pair two levels apart
    level = F.floor(F.log(F.col("e") - F.col("s")) / F.log(F.lit(base))).cast("int")
    on = spots.where(F.col("e") - F.col("s") >= least).withColumn("_own", level)
    on = on.withColumn("_level", F.explode(F.array("_own", F.col("_own") - 1)))
    width = F.ceil(F.pow(F.lit(base), F.col("_level") + 1)).cast("long")
    tiles = F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))
    on = on.withColumn("_width", width).withColumn("_tile", F.explode(tiles))
    sides = [on.select("bucket", "_level", "_tile", *(F.col(c).alias(f"{c}{k}") for c in ("node", "s", "e", "_own", "_width"))) for k in (1, 2)]
    both = sides[0].join(sides[1], ["bucket", "_level", "_tile"]).where("node1 < node2 AND (_own1 = _level OR _own2 = _level)")
    later = F.greatest("s1", "s2")
    shared = F.least("e1", "e2") - later
    longer = F.greatest(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"))
    linked = (shared >= least) & (shared / longer >= share) & (F.col("_tile") == F.floor(later / F.col("_width1")))
    return both.where(linked).select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def collapse_members(hits: DataFrame, bucket: list[str], least: int = 1, share: float = 0.0) -> DataFrame:
    """Every hit with the node of its component (I9): the least hit_id of its own or another linked interval.

    Two hits of a bucket are linked if they overlap by `least` positions and by `share` of the longer one; components
    are what links join, directly or by others. Equal intervals are one node, so that copies make no pairs. Without a
    share no pair is made: intervals of `least` positions or more are linked in a chain of their order, if the running
    end reaches far enough into the next one.
    """
    if least < 1 or not 0 <= share <= 1:
        raise ValueError("least must be 1 or more, and share between 0 and 1")
    broken = F.when((F.col("s") < 0) | (F.col("e") <= F.col("s")) | F.col("s").isNull() | F.col("e").isNull(), F.raise_error(F.lit("hits need positive half-open intervals")))
    # the bucket as one struct: in a struct nulls are equal, also to a join
    hits = hits.withColumns({c: F.coalesce(broken.cast("long"), c) for c in ("s", "e")}).withColumn("_bucket", F.struct(*bucket))
    spots = hits.groupBy(F.col("_bucket").alias("bucket"), "s", "e").agg(F.min("hit_id").alias("node"))
    if not share:
        long = merge_rows(spots.where(F.col("e") - F.col("s") >= least), ["bucket"], "s", "e", least)
        roots = long.groupBy("bucket", "island").agg(F.min("node").alias("root"))
        named = long.join(roots, ["bucket", "island"]).select("node", "root")
    else:
        named = components(overlap_links(spots, least, share))
    named = spots.join(named, "node", "left").select(F.col("bucket").alias("_bucket"), "s", "e", F.coalesce("root", "node").alias("component"))
    out = hits.join(named, ["_bucket", "s", "e"]).drop("_bucket")
    # a hit that is shorter than `least` is linked to nothing, not even to its copies
    return out.withColumn("component", F.when(F.col("e") - F.col("s") < least, F.col("hit_id")).otherwise(F.col("component")))


def collapse_hits(members: DataFrame, bucket: list[str]) -> DataFrame:
    """One event per component of collapse_members, with its representative and what it rests on.

    Representative: the best calibrated quality; in a component where no hit has one, the best (least) local rank; then
    the least priority, start, end, motif and id. A hit with neither quality nor rank is an error. The event's id is a
    hash of the bucket and the representative's interval; it is valid if all of its hits are. What hits it rests on are
    the rows of `members`, whose number no event bounds.
    """
    quality = F.when(~F.isnan("quality") & (F.abs("quality") < float("inf")), F.col("quality"))
    rank = F.when(quality.isNull(), F.coalesce("local_rank", F.raise_error(F.lit("a hit needs a calibrated quality or a local rank")).cast("long")))
    order = F.struct(quality.isNull().alias("bare"), (-quality).alias("worst"), rank.alias("rank"), "priority", "s", "e", "motif_id", "hit_id")
    out = members.groupBy("component", *bucket).agg(
        F.min(order).alias("best"),
        F.min("s").alias("from_s"),
        F.max("e").alias("to_e"),
        F.count("*").alias("n_hits"),
        F.count_distinct("motif_id").alias("n_motifs"),
        F.bool_and("valid").alias("valid"),
    )
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*bucket, "best.s", "best.e"]))
    picked = [F.col(f"best.{c}").alias(c) for c in ("s", "e", "motif_id")]
    return out.select(short_id("event:", name).alias("event_id"), *bucket, F.col("best.hit_id").alias("representative"), *picked, "from_s", "to_e", "n_hits", "n_motifs", "valid", "component")


def open_hits(peaks: DataFrame, same: list[str]) -> DataFrame:
    """Events that rest on accessibility alone; exact repeats collapse."""
    return peaks.groupBy(*same).agg(F.count("*").alias("n_peaks"), F.max("support").alias("support"), F.min("peak_id").alias("peak_id"))


def local_rank(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks by score within the keys; ties go to the least id."""
    return hits.withColumn("local_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "hit_id")))


def base_fractions(sequence: Column) -> dict[str, Column]:
    """Shares of A, C, G and T among these four; NULL without any."""
    n = F.length(F.regexp_replace(sequence, "[^ACGT]", ""))
    return {b: F.try_divide(F.length(F.regexp_replace(sequence, f"[^{b}]", "")), n) for b in "ACGT"}


#: Letters that stand for several bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "W": "AT", "N": "ACGT"}


def one_of(letters: str):
    return lambda x: x.isin(*letters).cast("int")


def consensus_fraction(sequence: Column, consensus: str) -> Column:
    """The greatest share of positions at which a window of the sequence agrees with a consensus (I13); 0 if it is too short."""
    k, n = len(consensus), F.length(sequence)
    # agreement by place for each letter of the consensus, shifted and added up: linear in the sequence
    agrees = [F.transform(F.split(sequence, ""), one_of(IUPAC[c])) for c in consensus]
    total = F.slice(agrees[0], F.lit(1), n - k + 1)
    for i, a in enumerate(agrees[1:], 2):
        total = F.zip_with(total, F.slice(a, F.lit(i), n - k + 1), lambda x, y: x + y)
    return F.when(n >= k, F.array_max(total) / k).otherwise(F.lit(0.0))


def event_kind(routes: DataFrame) -> DataFrame:
    """The one kind of an event's routes, or MULTI_ANCHOR."""
    kinds = F.array_sort(F.collect_set("kind"))
    return routes.groupBy("event_id").agg(F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("MULTI_ANCHOR").alias("event_kind"))


def scan_pwm(sequences: DataFrame, pwm: dict[str, list[list[float]]], least: float, tile: int = 65536) -> DataFrame:
    """Hits of weight matrices on both strands (I11): columns seq_id, sequence -> seq_id, motif_id, start, strand, score.

    The score is the sum of log((p + 1e-6) / 0.25), brought to 0..1 between the matrix' least and greatest; windows with
    other letters than ACGT give none. Matrices are few and small and go with the tasks; a sequence is read whole, in
    tiles of `tile` windows, and hits leave in batches, so that long sequences need no more memory.
    """
    import math
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    tables = {m: np.array([[math.log((x + 1e-6) / 0.25) for x in row] for row in rows]) for m, rows in pwm.items()}

    def built(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["seq_id", "motif_id", "start", "strand", "score"]).astype({"start": "int64", "score": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = np.full(256, 4, np.uint8)
        code[[65, 67, 71, 84]] = range(4)
        for b in batches:
            out = []
            for seq_id, text in zip(b["seq_id"], b["sequence"], strict=True):
                x = code[np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8)]
                for m, t in tables.items():
                    k, low, high = len(t), t.min(1).sum(), t.max(1).sum()
                    for begin in range(0, len(x) - k + 1, tile):
                        windows = np.lib.stride_tricks.sliding_window_view(x[begin : begin + tile + k - 1], k)
                        good = np.flatnonzero((windows < 4).all(1))
                        windows = windows[good]
                        for strand, table in (("+", t), ("-", t[::-1, ::-1])):
                            score = (table[np.arange(k), windows].sum(1) - low) / max(high - low, 1e-12)
                            for at in np.flatnonzero(score >= least):
                                out.append((seq_id, m, begin + int(good[at]), strand, float(score[at])))
                        if len(out) > 100_000:
                            yield built(out)
                            out = []
            yield built(out)

    kind = sequences.schema["seq_id"].dataType.simpleString()
    return sequences.select("seq_id", "sequence").mapInPandas(run, f"seq_id {kind}, motif_id string, start long, strand string, score double")


def introns(exons: Column) -> Column:
    """Gaps between consecutive exons (G1)."""
    return F.filter(
        F.zip_with(F.slice(exons, F.lit(1), F.greatest(F.size(exons) - 1, F.lit(0))), F.slice(exons, F.lit(2), F.size(exons)), lambda a, b: F.struct(a.e.alias("s"), b.s.alias("e"))),
        lambda x: x.s.isNotNull(),
    )


def retained_intron_opportunities(paths: DataFrame) -> DataFrame:
    """Distinct junctions that some path splices and an exon of some path covers, with both lists of paths.

    paths: gene_id, path_id, exons (sorted).
    """
    j = paths.select("gene_id", "path_id", F.explode(introns(F.col("exons"))).alias("j")).select("gene_id", "path_id", "j.s", "j.e")
    spliced = j.groupBy("gene_id", "s", "e").agg(F.array_sort(F.collect_set("path_id")).alias("spliced_by"))
    x = paths.select("gene_id", F.col("path_id").alias("cover_id"), F.explode("exons").alias("x")).select("gene_id", "cover_id", F.col("x.s").alias("xs"), F.col("x.e").alias("xe"))
    covered = spliced.join(x, "gene_id").where("xs <= s AND xe >= e")
    return covered.groupBy("gene_id", "s", "e", "spliced_by").agg(F.array_sort(F.collect_set("cover_id")).alias("retained_by"))


def anchor_regions(nodes: DataFrame, edges: DataFrame, flanks: dict[str, tuple[int, int]], contigs: DataFrame, modality: str, most_exon: int = 500) -> DataFrame:
    """Site windows and edge regions that carry routes.

    A site (a node of a type in `flanks`, upstream and downstream) is a window along the strand, clipped to the contig,
    on every edge that leaves a TSS or donor or enters an acceptor or PAS. Every edge with a span is a region too; for
    RNA only exons of at most `most_exon` positions. contigs: chrom, length.
    """
    kinds = list(flanks)
    up = F.coalesce(*(F.when(F.col("node_type") == k, F.lit(flanks[k][0])) for k in kinds))
    down = F.coalesce(*(F.when(F.col("node_type") == k, F.lit(flanks[k][1])) for k in kinds))
    n = nodes.where(F.col("node_type").isin(kinds)).withColumns({"_a": -up, "_b": down})
    minus = F.col("strand") == "-"
    raw_s, raw_e = F.when(minus, F.col("pos") - F.col("_b")).otherwise(F.col("pos") + F.col("_a")), F.when(minus, F.col("pos") - F.col("_a")).otherwise(F.col("pos") + F.col("_b"))
    n = n.join(F.broadcast(contigs), "chrom").withColumns({"raw_s": raw_s, "raw_e": raw_e})
    n = n.withColumns({"s": F.greatest(F.lit(0), "raw_s"), "e": F.least("length", "raw_e")}).where("e > s")
    leaves = F.col("node_type").isin("TSS", "donor")
    out = n.where(leaves).join(edges.select("gene_id", "edge_id", F.col("src").alias("node_id")), ["gene_id", "node_id"])
    into = n.where(~leaves).join(edges.select("gene_id", "edge_id", F.col("dst").alias("node_id")), ["gene_id", "node_id"])
    site = out.unionByName(into).select(
        "gene_id", F.concat(F.col("gene_id").cast("string"), F.lit(":site:"), "node_id").alias("anchor_id"), "edge_id", "strand", "s", "e", F.lit("site").alias("kind"),
        F.col("node_type").alias("anchor_type"), ((F.col("s") != F.col("raw_s")) | (F.col("e") != F.col("raw_e"))).alias("clipped"),
    )
    short = (F.col("edge_type") == "EXON_CONTINUATION") & (F.col("hi") - F.col("lo") <= most_exon)
    own = edges.where(F.col("hi") > F.col("lo")).where(short if modality == "RNA" else F.lit(True))
    region = own.select(
        "gene_id", F.concat(F.col("gene_id").cast("string"), F.lit(":edge:"), "edge_id").alias("anchor_id"), "edge_id", "strand", F.col("lo").alias("s"), F.col("hi").alias("e"), F.lit("edge").alias("kind"),
        F.lit("EDGE").alias("anchor_type"), F.lit(False).alias("clipped"),
    )
    return site.unionByName(region)
