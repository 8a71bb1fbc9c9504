"""Reads against paths: CIGAR evidence, quality reasons, retained introns and compatible paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import reasons
from .intervals import IV, merge_array, subtract


def expand_cigar(cigar: Column, start: Column) -> Column:
    """Blocks, junctions with their anchors, deletions and clips of an alignment (C1), by one fold over the operations.

    M, = and X extend the open block; D closes it and is recorded; N closes it and gives a junction, whose anchors are
    the runs of matches next to it on both sides, which any other operation ends; S and H are clips; I and P move nothing.
    """
    ops = F.transform(
        F.regexp_extract_all(cigar, F.lit(r"[0-9]+[MIDNSHP=X]"), F.lit(0)),
        lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("n"), F.right(x, F.lit(1)).alias("op")),
    )
    junction = "struct<s:bigint,e:bigint,left:bigint,right:bigint>"
    none = F.array().cast(IV)
    zero = F.struct(
        start.cast("bigint").alias("pos"), F.lit(None).cast("bigint").alias("open"), F.lit(0).cast("bigint").alias("run"), F.lit(False).alias("touches"), none.alias("blocks"),
        F.array().cast(f"array<{junction}>").alias("junctions"), none.alias("deletions"), F.lit(0).cast("bigint").alias("clipped"), F.lit(None).cast(junction).alias("last"),
    )
    # the last junction is carried apart, so that a match that lengthens it rebuilds no array
    closed_junctions = lambda a: F.when(a.last.isNotNull(), F.array_append(a.junctions, a.last)).otherwise(a.junctions)

    def step(a: Column, x: Column) -> Column:
        match, gap = x.op.isin("M", "=", "X"), x.op.isin("D", "N")
        closed = F.when(gap & a.open.isNotNull(), F.array_append(a.blocks, F.struct(a.open.alias("s"), a.pos.alias("e")))).otherwise(a.blocks)
        longer = F.struct(a.last.s.alias("s"), a.last.e.alias("e"), a.last.left.alias("left"), (a.last.right + x.n).alias("right"))
        new = F.struct(a.pos.alias("s"), (a.pos + x.n).alias("e"), a.run.alias("left"), F.lit(0).cast("bigint").alias("right"))
        last = F.when(x.op == "N", new).when(match & a.touches, longer).otherwise(a.last)
        spliced = F.when(x.op == "N", closed_junctions(a)).otherwise(a.junctions)
        return F.struct(
            F.when(match | gap, a.pos + x.n).otherwise(a.pos).alias("pos"),
            F.when(match, F.coalesce(a.open, a.pos)).when(gap, F.lit(None).cast("bigint")).otherwise(a.open).alias("open"),
            F.when(match, a.run + x.n).otherwise(F.lit(0).cast("bigint")).alias("run"),
            ((x.op == "N") | (match & a.touches)).alias("touches"),
            closed.alias("blocks"), spliced.alias("junctions"),
            F.when(x.op == "D", F.array_append(a.deletions, F.struct(a.pos.alias("s"), (a.pos + x.n).alias("e")))).otherwise(a.deletions).alias("deletions"),
            F.when(x.op.isin("S", "H"), a.clipped + x.n).otherwise(a.clipped).alias("clipped"), last.alias("last"),
        )

    end = lambda a: F.struct(
        merge_array(F.when(a.open.isNotNull(), F.array_append(a.blocks, F.struct(a.open.alias("s"), a.pos.alias("e")))).otherwise(a.blocks)).alias("blocks"),
        closed_junctions(a).alias("junctions"), a.deletions.alias("deletions"), a.clipped.alias("clipped"),
    )
    return F.aggregate(ops, zero, step, end)


#: Fixed value: the shape of read names, barcode_umi#id_strand.
READ_NAME = r"^([ACGTN]{16})_([ACGTN]{12})#([0-9a-fA-F-]+)_([+-])$"


def parse_read_name(name: Column) -> Column:
    """Barcode, UMI, id and strand of a read name, or the reason why not."""
    part = lambda k: F.nullif(F.regexp_extract(name, READ_NAME, k), F.lit(""))
    return F.struct(part(1).alias("barcode"), part(2).alias("umi"), part(3).alias("read_id"), part(4).alias("strand"), F.when(~name.rlike(READ_NAME), "unparsed_read_name").alias("reason"))


def qc_reasons(primary: Column, parsed: Column, mapq: Column, supplementary: Column, strand_ok: Column, evidence: Column, least_mapq: int, least_anchor: int, most_deletion: int) -> Column:
    """Sorted reasons against an alignment."""
    return F.array_sort(
        reasons(
            (~primary, "not_primary"), (~parsed, "unparsed_read_name"), (mapq < least_mapq, "mapq_below_minimum"), (supplementary, "supplementary_alignment"), (~strand_ok, "strand_conflict"),
            (F.exists(evidence.junctions, lambda j: F.least(j.left, j.right) < least_anchor), "short_anchor"), (F.exists(evidence.deletions, lambda d: d.e - d.s > most_deletion), "long_deletion"), (F.size(evidence.blocks) == 0, "no_evidence"),
        )
    )


def near(a: Column, b: Column, tolerance: int) -> Column:
    return (F.abs(a.s - b.s) <= tolerance) & (F.abs(a.e - b.e) <= tolerance)


def ir_evidence(blocks: Column, junctions: Column, opportunities: Column, tolerance: int, margin: int) -> Column:
    """Retained introns that a read supports (a block spans both boundaries by the margin) or leaves open (C4)."""
    left = F.filter(opportunities, lambda o: ~F.exists(junctions, lambda j: near(j, o, tolerance)))
    spans = lambda o: F.exists(blocks, lambda b: (b.s <= o.s - margin) & (b.e >= o.e + margin)) & (o.e - o.s >= 2 * margin)
    touches = lambda o: F.exists(blocks, lambda b: (b.s < o.e) & (o.s < b.e))
    return F.struct(F.filter(left, spans).alias("supported"), F.filter(left, lambda o: ~spans(o) & touches(o)).alias("censored"))


def compatible_paths(reads: DataFrame, paths: DataFrame, tolerance: int) -> DataFrame:
    """Paths that explain all of a read (C5): every junction matches one of the path's, every block, without censored
    introns, lies in one of its exons, both within the tolerance.

    reads: gene_id, read_id, blocks, junctions, censored; paths: gene_id, path_id, exons. The paths of a gene are few and
    are gathered into one array per gene, so that the join has one row per read.
    """
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("exons"), F.lit(1))), lambda i: F.struct(F.get("exons", i - 1).e.alias("s"), F.get("exons", i).s.alias("e")))
    per = paths.withColumn("gaps", F.filter(gaps, lambda g: g.e.isNotNull())).groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("path_id", "exons", "gaps"))).alias("legal"))
    d = reads.join(per, "gene_id").withColumn("rest", F.aggregate("censored", F.col("blocks"), lambda a, c: subtract(a, c.s, c.e)))
    within = lambda b, x: (b.s >= x.s - tolerance) & (b.e <= x.e + tolerance)
    fits = lambda p: F.forall("junctions", lambda j: F.exists(p.gaps, lambda g: near(j, g, tolerance))) & F.forall("rest", lambda b: F.exists(p.exons, lambda x: within(b, x)))
    return d.withColumn("compatible", F.transform(F.filter("legal", fits), lambda p: p.path_id)).withColumn("n_legal", F.size("legal")).drop("legal", "rest")


def assign_gene_cell(alignments: DataFrame, tx_gene: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gene by transcript tag and cell by (donor, library, barcode); held-out test cells never appear.

    Returns the resolved rows and counts of what was not. Where both sides have them (chrom, start; gene_chrom, gene_end),
    an alignment on another chromosome than its gene's, or one that starts behind its gene's end, is an error.
    """
    d = alignments.join(tx_gene, "tx_id", "left").join(cells, ["donor_id", "library_id", "barcode"], "left")
    fault = F.lit(None).cast("string")
    named = F.concat(F.lit(" of transcript "), F.col("tx_id").cast("string"), F.lit(", gene "), F.col("gene_id").cast("string"))
    if {"chrom", "gene_chrom"} <= {*d.columns}:
        fault = F.when(F.col("gene_id").isNotNull() & ~F.col("chrom").eqNullSafe(F.col("gene_chrom")), F.concat(F.lit("chromosome conflict"), named))
    if {"start", "gene_end"} <= {*d.columns}:
        fault = F.coalesce(fault, F.when(F.col("start") >= F.col("gene_end"), F.concat(F.lit("start behind the gene's end"), named)))
    why = F.when(F.col("gene_id").isNull(), "unknown_transcript").when(F.col("cell_id").isNull(), "unknown_cell").when(F.col("split") == "test", "test_cell")
    d = d.withColumn("unresolved", F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(why))
    return d.where("unresolved IS NULL").drop("unresolved"), d.groupBy("unresolved").agg(F.count("*").alias("rows"))


def intron_evidence(rows: DataFrame, least_mapq: int, least_exon: int, least_intron: int) -> DataFrame:
    """What a molecule says about an intron, by both of its boundaries (C11).

    rows: molecule_id, intron_id (once together), is_primary, is_chimeric, mapq, left_exon, left_intron, right_intron,
    right_exon (aligned positions), excising, other_junctions, unspliced_introns, mature. A boundary is supported with
    `least_exon` and `least_intron` positions on its two sides. Retention is supported by both boundaries without an
    excising junction, and censored where the molecule passes but does not show it. `scope` says how far a supported one
    may be read: as mature by the protocol, as processed beside another splice junction, or as unresolved.
    """
    if least_mapq < 0 or least_exon <= 0 or least_intron <= 0:
        raise ValueError("evidence thresholds are not valid")
    twice = F.count("*").over(Window.partitionBy("molecule_id", "intron_id")) > 1
    qc = F.col("is_primary") & ~F.col("is_chimeric") & (F.col("mapq") >= least_mapq)
    d = rows.withColumn("qc_pass", F.when(twice, F.raise_error(F.lit("a molecule has an intron twice")).cast("boolean")).otherwise(qc))
    side = lambda x: (F.col(f"{x}_exon") >= least_exon) & (F.col(f"{x}_intron") >= least_intron)
    d = d.withColumns({"left_supported": F.col("qc_pass") & side("left"), "right_supported": F.col("qc_pass") & side("right")})
    left, right = F.col("left_supported"), F.col("right_supported")
    covered = F.greatest("left_intron", "right_intron") > 0
    name = (
        F.when(~F.col("qc_pass"), "qc_failure").when(F.col("excising"), "excising_junction").when(left & right, "bilateral").when(left | right, "single_boundary").when(covered, "intron_only")
    ).otherwise("no_boundary")
    d = d.withColumn("evidence", name).withColumn("supported", F.col("evidence") == "bilateral")
    processed = F.col("other_junctions") > 0
    scope = F.when(~F.col("supported"), "not_retained").when(F.col("mature"), "mature_by_protocol").when(processed, "processed_context").otherwise("mature_or_nascent")
    return d.withColumns(
        {
            "censored": F.col("qc_pass") & ~F.col("supported"),
            "biogenesis": F.when(processed, "processed_context").otherwise("mature_or_nascent"),
            "several_unspliced": F.col("unspliced_introns") > 1,
            "scope": scope,
        }
    )


def classify_retained_intron(df: DataFrame, margin: int) -> DataFrame:
    """Class of a read's view of an intron (C11): s, e are the read's covered span, is_, ie the intron's bounds."""
    left, right = (F.col("s") <= F.col("is_") - margin) & (F.col("e") > F.col("is_")), (F.col("e") >= F.col("ie") + margin) & (F.col("s") < F.col("ie"))
    inside = (F.col("s") >= F.col("is_")) & (F.col("e") <= F.col("ie"))
    name = F.when(~F.col("qc_pass"), "qc_fail").when(left & right, "bilateral").when(left | right, "single_boundary").when(inside, "intron_only").otherwise("not_covering")
    return df.withColumns({"left_boundary": left, "right_boundary": right, "ir_class": name})


def rebuild_after_ir(rows: DataFrame) -> DataFrame:
    """Path sets with the retained-intron evidence put in (C12): supported adds ir paths, else all legal where nothing is left.

    rows: non_ir ARRAY, ir ARRAY, legal ARRAY, supported BOOLEAN.
    """
    plain = F.when(F.size("non_ir") > 0, F.col("non_ir")).otherwise(F.col("legal"))
    chosen = F.when(F.col("supported"), F.array_union("non_ir", "ir")).otherwise(plain)
    ordered = F.filter("legal", lambda p: F.array_contains(chosen, p))
    d = rows.withColumn("paths", ordered)
    return d.withColumn("fate", F.when(F.size("paths") == 0, "empty").when(F.size("paths") == F.size("legal"), "full").otherwise("informative"))
