"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame;
each result is written as Parquet and read again as the next stage's ``docs``.

All stages but the last return the columns of ``docs``, extra ones included, whatever their names.
Ids may be null and repeat, repeated rows are rows of their own unless a stage says otherwise, texts
of any length are taken whole, and an empty table stays empty."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.llm import jaccard, packing, quality, suffix, toxicity
from presswire.llm.common import discard, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts have no evidence and stay. Repeated
    rows stay or go together."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (null ids come
    first; of rows with one id and text one stays). Rows without words stay."""
    return jaccard.keep(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go from the texts; every document stays, and n_chars follows (null for
    a null text)."""
    return suffix.strip(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences; a null or empty text is a
    piece of one separator. Pieces of equal length come in the order of ids and text hashes."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL has no way to fit the model, to run the tokeniser or to pack; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Only the last stage's table stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", []
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        discard(spark, *before)
        before = [f"{folder}/{name}"]
    return docs
