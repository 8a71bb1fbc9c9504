"""Deterministic splits, support, selection tiers and crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import hash32


def stratified_hash_split(cells: DataFrame, seed: int, val: float = 0.1, test: float = 0.1, cell: str = "cell_id", stratum: str = "stratum") -> DataFrame:
    """Splits every stratum in hash order: floor(val n) to val, floor(test n) to test, the first rest to train (L1).

    The order is by the SHA-256 of the canonical JSON of seed, stratum and id, then id: no input order matters.
    """
    text = F.to_json(F.struct(F.lit(seed).alias("split_seed"), F.col(stratum).alias("stratum"), F.col(cell).alias("id")))
    d = cells.withColumn("key", F.sha2(text, 256))
    w = Window.partitionBy(stratum)
    d = d.withColumn("k", F.row_number().over(w.orderBy("key", cell))).withColumn("n", F.count("*").over(w))
    n_val, n_test = F.floor(F.col("n") * val), F.floor(F.col("n") * test)
    name = F.when(F.col("k") <= F.col("n") - n_val - n_test, "train").when(F.col("k") <= F.col("n") - n_test, "val").otherwise("test")
    return d.withColumn("split", name).drop("k", "n")


def split_summary(split: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Cells by stratum and split, one column per split (L2)."""
    return split.groupBy(stratum).pivot("split", ["train", "val", "test"]).count().fillna(0)


def normalize_name(name: Column) -> Column:
    """Letters and digits only, upper case (L3)."""
    return F.upper(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def resolve_crosswalk(names: DataFrame, legacy: DataFrame, known: DataFrame) -> DataFrame:
    """Resolves names by ordered rules (L4): a legacy id; a novel number, padded to six digits; an embedded transcript id;
    the only known name with the same normalised form. Columns: name, resolved, rule (NULL where nothing fits).

    legacy: name, target. known: target (allowed ids), name.
    """
    novel = F.regexp_extract("name", r"(?i)[_-]nr[_-]0*([0-9]+)$", 1)
    embedded = F.regexp_extract("name", r"(ENST[0-9]{11})", 1)
    only = known.groupBy(normalize_name(F.col("name")).alias("norm")).agg(F.count_distinct("target").alias("k"), F.min("target").alias("by_name")).where("k = 1").drop("k")
    r = names.withColumn("norm", normalize_name(F.col("name"))).join(legacy.select("name", F.col("target").alias("by_legacy")), "name", "left").join(only, "norm", "left")
    by_novel = F.when(novel != "", F.concat(F.regexp_replace("name", r"(?i)[_-]nr[_-][0-9]+$", ""), F.lit("_nr_"), F.lpad(novel, 6, "0")))
    rules = [("legacy", F.col("by_legacy")), ("embedded", F.when(embedded != "", embedded)), ("novel", by_novel), ("name", F.col("by_name"))]
    rule = F.coalesce(*(F.when(c.isNotNull(), F.lit(k)) for k, c in rules))
    return r.select("name", F.coalesce(*(c for _, c in rules)).alias("resolved"), rule.alias("rule"))


def feature_support(counts: DataFrame, cells: DataFrame, axis: DataFrame) -> DataFrame:
    """Total count and positive cells of every path of the axis over the given cells; 0 where there are none."""
    own = counts.join(cells.select("cell_id"), "cell_id", "left_semi").groupBy("path_id").agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("positive_cells")
    )
    return axis.select("gene_id", "path_id").join(own, "path_id", "left").fillna({"total": 0, "positive_cells": 0})


def gene_audit(support: DataFrame, least: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """Per gene: paths, observed paths, total, its three greatest paths, the rest, and paths of count and cells >= k."""
    w = Window.partitionBy("gene_id").orderBy(F.col("total").desc(), "path_id")
    r = support.withColumn("rn", F.row_number().over(w))
    tops = [c for k in (1, 2, 3) for c in (F.max(F.when(F.col("rn") == k, F.col("path_id"))).alias(f"top{k}"), F.max(F.when(F.col("rn") == k, F.col("total"))).alias(f"top{k}_count"))]
    enough = [F.count_if((F.col("total") >= k) & (F.col("positive_cells") >= k)).alias(f"paths_ge_{k}") for k in least]
    rest = F.sum(F.when(F.col("rn") > 1, F.col("total")).otherwise(0)).alias("non_dominant")
    return r.groupBy("gene_id").agg(F.count("*").alias("n_paths"), F.count_if(F.col("total") > 0).alias("observed_paths"), F.sum("total").alias("total"), *tops, rest, *enough)


def stratum_breadth(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Strata in which at least two, and three, paths of a gene are observed."""
    seen = counts.where("n > 0").join(cells, "cell_id").groupBy("gene_id", "stratum").agg(F.count_distinct("path_id").alias("k"))
    return seen.groupBy("gene_id").agg(F.count_if(F.col("k") >= 2).alias("strata_ge_2"), F.count_if(F.col("k") >= 3).alias("strata_ge_3"))


def location_class(loci: DataFrame) -> DataFrame:
    """A gene's class by its places: nuclear on one canonical chromosome and strand, mitochondrial, else alternative."""
    by = loci.groupBy("gene_id").agg(F.array_sort(F.collect_set("chrom")).alias("c"), F.array_sort(F.collect_set("strand")).alias("s"))
    one = (F.size("c") == 1) & (F.size("s") == 1)
    first = F.element_at("c", 1)
    kind = F.when(one & first.rlike("^chr([0-9]+|X|Y)$"), "nuclear").when(one & (first == "chrM"), "mitochondrial").otherwise("alternative")
    return by.select("gene_id", F.array_join("c", "|").alias("chroms"), F.array_join("s", "|").alias("strands"), kind.alias("location"))


def selection_tiers(audit: DataFrame, canonical: Column) -> DataFrame:
    """Tier of a gene: selected (>= 2 paths, canonical), conditional (> 2 paths elsewhere), else excluded with a reason."""
    tier = F.when(canonical & (F.col("n_paths") >= 2), "selected").when(~canonical & (F.col("n_paths") > 2), "conditional").otherwise("excluded")
    why = F.when(tier == "selected", "canonical_multi_path").when(tier == "conditional", "alternative_multi_path").when(F.col("n_paths") < 2, "single_path").otherwise("alternative_few_paths")
    return audit.withColumns({"tier": tier, "tier_reason": why})


def train_fit_axis(ec: DataFrame, axis: DataFrame) -> DataFrame:
    """All genes with whether training evidence fits them: informative mass above 0 (L10). ec: gene_id, split, fate, mass."""
    fit = ec.where("split = 'train' AND fate = 'informative'").groupBy("gene_id").agg(F.sum("mass").alias("mass")).where("mass > 0")
    out = axis.select("gene_id").distinct().join(fit, "gene_id", "left")
    return out.select("gene_id", F.coalesce("mass", F.lit(0)).alias("train_mass"), F.col("mass").isNotNull().alias("fits"))


def gtf_crosscheck(paths: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Names of the sources that hold a path with equal gene, chromosome, strand and exon arrays."""
    same, out = ["gene_id", "chrom", "strand", "exons"], paths
    for name, s in sources.items():
        out = out.join(s.select(*same).distinct().withColumn(f"in_{name}", F.lit(name)), same, "left")
    return out.withColumn("sources", F.array_compact(F.array(*(F.col(f"in_{n}") for n in sources)))).drop(*(f"in_{n}" for n in sources))


def symbol_axis(genes: DataFrame) -> DataFrame:
    """Symbols (upper case) that name exactly one gene; the others map to NULL."""
    by = genes.groupBy(F.upper("symbol").alias("symbol")).agg(F.count_distinct("gene_id").alias("n_genes"), F.min("gene_id").alias("g"))
    return by.select("symbol", "n_genes", F.when(F.col("n_genes") == 1, F.col("g")).alias("gene_id"))


def expected_cell_gene_axis(ec: DataFrame) -> DataFrame:
    """Distinct (gene, cell) pairs of informative rows of the validation split (L13); number them with contracts.numbered."""
    return ec.where("split = 'val' AND fate = 'informative'").select("gene_id", "cell_id").distinct()


def build_count_target(counts: DataFrame, paths: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts over the given paths and cells, with both axes' dense indices (L14). paths: path_id, path_i; cells: cell_id, cell_i."""
    return counts.join(paths, "path_id").join(cells, "cell_id").select("path_i", "cell_i", "n")


def cell_key_lookup(cells: DataFrame, libraries: DataFrame) -> DataFrame:
    """Splits `prefix_barcode` names and maps the prefix to donor and library (L15). libraries: prefix, donor_id, library_id."""
    parts = cells.withColumn("prefix", F.regexp_extract("name", "^(.*)[_-]([ACGTN]+)$", 1)).withColumn("barcode", F.regexp_extract("name", "^(.*)[_-]([ACGTN]+)$", 2))
    return parts.join(libraries, "prefix", "left")


def factor_catalog(mapping: DataFrame, genes: DataFrame) -> DataFrame:
    """Factor entities with their members (L16): groups need two members or more, and all of them on the gene axis."""
    m = mapping.join(genes.select("gene_id").distinct().withColumn("known", F.lit(True)), "gene_id", "left")
    by = m.groupBy("entity_id").agg(F.array_sort(F.collect_set("gene_id")).alias("m"), F.count_if(F.col("known").isNull()).alias("off_axis"), F.min("kind").alias("kind"), F.count_distinct("kind").alias("kinds"))
    why = F.when(F.col("kinds") > 1, "inconsistent_kind").when((F.col("kind") == "group") & (F.size("m") < 2), "group_too_small").when(F.col("off_axis") > 0, "member_off_axis")
    return by.select("entity_id", F.array_join("m", ",").alias("members"), "off_axis", F.coalesce(why, F.lit("valid")).alias("status"))


def bernoulli(share: float, *parts) -> Column:
    """Whether a key falls into a share of the portable hash range."""
    return hash32(*parts) < int(share * (1 << 32))
