"""Sources and sinks: pruned scans, delimited files, triplets, annotations, sharded writes and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pruned(spark: SparkSession, path: str, columns: list[str], key: str | None = None, values: list | None = None) -> DataFrame:
    """Parquet with only these columns and, if given, only these keys, pushed to the scan; an empty list is an error."""
    if values is not None and not values:
        raise ValueError("an empty list of keys selects nothing; pass None for all")
    df = spark.read.parquet(path).select(*columns)
    return df.where(F.col(key).isin(values)) if values is not None else df


def read_split(df: DataFrame) -> DataFrame:
    """Cells with exactly one RNA__ prefix taken off (S3); collisions and unknown labels make the row's `error`."""
    from pyspark.sql import Window

    cell = F.regexp_replace("cell_id", "^RNA__", "")
    d = df.withColumn("cell_id", cell)
    n = F.count("*").over(Window.partitionBy("cell_id"))
    return d.withColumn("error", F.when(n > 1, "collision").when(~F.col("split").isin("train", "val", "test"), "unknown_label"))


def attribute(name: str, text: str = "attributes") -> Column:
    return F.nullif(F.regexp_extract(text, name + r'\s+"([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts and exons of an annotation, 0-based half-open, ids without version."""
    names = "chrom source feature start end score strand frame attributes".split()
    raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    bare = lambda c: F.regexp_replace(c, r"\.[0-9]+$", "")
    return raw.where(F.col("feature").isin("transcript", "exon")).select(
        "chrom", "feature", (F.col("start").cast("long") - 1).alias("s"), F.col("end").cast("long").alias("e"), "strand", bare(attribute("gene_id")).alias("gene_id"), bare(attribute("transcript_id")).alias("tx_id"), attribute("gene_name").alias("symbol"),
    )


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a coordinate matrix file, 0-based (S5). The size line is the first that is no comment: it is told apart
    by summing to no entry of its own, and comes back with `is_size`."""
    t = spark.read.text(path).where(~F.col("value").startswith("%"))
    p = t.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 3)
    d = p.select(F.get("p", F.lit(0)).cast("long").alias("i"), F.get("p", F.lit(1)).cast("long").alias("j"), F.get("p", F.lit(2)).cast("long").alias("n"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("k"))
    first = d.groupBy("f").agg(F.min("k").alias("k")).withColumn("is_size", F.lit(True))
    d = d.join(F.broadcast(first), ["f", "k"], "left").fillna({"is_size": False})
    return d.select((F.col("i") - (~F.col("is_size")).cast("int")).alias("row_id"), (F.col("j") - (~F.col("is_size")).cast("int")).alias("col_id"), "n", "is_size")


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of a headerless interval file with ids chrom:start-end."""
    d = spark.read.csv(path, sep="\t", schema="chrom string, s long, e long")
    return d.withColumn("peak_id", F.format_string("%s:%d-%d", "chrom", "s", "e"))


def read_delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed tab-separated table with a header; a malformed row is an error."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST")


def write_dataset(df: DataFrame, path: str, partition: str, keys: list[str]) -> None:
    """One folder per partition value, rows sorted by key within each file; an existing target is an error.

    Rows are dealt by ranges of value and keys, so that a value of many rows has several files.
    """
    df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), partition, *keys).sortWithinPartitions(partition, *keys).write.partitionBy(partition).mode("errorifexists").parquet(path)


def merge_shards(shards: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All shards together, and the keys that more than one of them holds."""
    merged, owners = None, None
    for k, s in enumerate(shards):
        own = s.select(key).distinct().withColumn("shard", F.lit(k))
        merged, owners = (s, own) if merged is None else (merged.unionByName(s), owners.unionByName(own))
    return merged, owners.groupBy(key).agg(F.count("*").alias("shards")).where("shards > 1")


def prepared_features(paths: DataFrame, counts: DataFrame, ec: DataFrame) -> DataFrame:
    """One nested record per gene: ordered paths, counts by cell, evidence rows, and masses that close."""
    p = paths.groupBy("gene_id").agg(F.array_sort(F.collect_set("path_id")).alias("paths"))
    c = counts.groupBy("gene_id", "cell_id").agg(F.sum("n").alias("n")).groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", "n"))).alias("cells"), F.sum("n").alias("count_mass"))
    e = ec.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", "paths_key", "mass"))).alias("evidence"), F.sum("mass").alias("evidence_mass"))
    return p.join(c, "gene_id", "left").join(e, "gene_id", "left")


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Canonical JSON of a one-row description with sorted keys, and its SHA-256."""
    text = F.to_json(F.struct(*sorted(columns)))
    return df.select(text.alias("manifest"), F.sha2(text, 256).alias("sha256"))
