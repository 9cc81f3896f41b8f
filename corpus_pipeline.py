"""Corpus pipeline over `documents`: toxic documents go, one of each group of near-duplicates stays, documents
that hold benchmark passages go, and the rest is encoded. Each stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import decontam, simhash, toxicity, unigram
from folioframe.llm.common import configure, table, written

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more by the classifier trained on the labels that are not held out."""
    configure(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every component of SimHash links."""
    configure(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which at least a twentieth of the words lie in benchmark windows."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces (ids), n_tokens and round_trip (whether the ids read back as the text)."""
    configure(spark)
    coded = unigram.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path(PIECES), keep=("doc_id", "text"))
    return coded.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("unigram", encode)]

#: Classifier, fingerprints and pieces cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
