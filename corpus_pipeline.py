"""A corpus pipeline of five stages, each over all that its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` applies them to the documents
of ``sf_dir``; between stages rows are written as Parquet and read again, so a lost executor costs no
more than the stage that it worked on. What a stage wrote is removed once the next one has written; the
last table goes when the session ends. All stages but the last return the columns of the documents.

Defined results: null and empty texts go through every stage as empty texts; rows that repeat an id are
judged by their texts; rows without id are rows like any other; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontaminate, overlap, pieces, quality, secrets
from papyra.llm.common import table
from papyra.session import checkpoint_dir, remove, remove_at_exit


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; the rest goes."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 of five-word shingles): the one with the smallest id.

    Different texts that share an id, and texts without id, are documents of their own.
    """
    return overlap.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span replaced in their texts and ``n_chars`` counted anew."""
    clean = secrets.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the packed piece ids and spans, and the decoded text of every document."""
    made = pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", "ids", "starts", "ends", "decoded")


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("piece encoding", encode),
]

#: The classifier and the fingerprints are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return docs
