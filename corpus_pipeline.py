"""A corpus pipeline of five stages: language, lines, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads as the next stage's docs. All but the last return the columns of documents. Duplicate lines are cut before
near-duplicate documents are sought, so that copies of single passages don't hide what differs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm import bpe, langid, linededup, mixing, neardup
from tallgrass.llm.common import digest, saved, table
from tallgrass.llm.queries import TARGETS, domains_of

#: Documents are rejected below this score; with few languages, about that of a text in none of them.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is recognised."""
    said = langid.predict(docs, langid.fit(docs))
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated and nearly repeated lines; documents of which nothing is left go."""
    cut = linededup.deduplicated(docs)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"\S")
    return cut.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return neardup.deduplicated(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by their rates (1 at most, so that none comes twice)."""
    labels = domains_of(table(spark, sf_dir, "labels"))
    rated, _ = mixing.mixed(docs, labels, TARGETS, budget=0.8, max_rate=1.0)
    return rated.where("copies > 0").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document, and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(docs, path, decoded="decoded")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: No SQL: the stages learn models and draw hashes. tests/llm/test_pipeline.py compares lines, near-duplicates and tokens
#: with brute force; of language and mixture it checks how much stays, their models being tested with their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
