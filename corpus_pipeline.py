"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Every stage reads all that its predecessor kept; all but the last return the columns of documents. Defined cases: a null
or empty text fails the quality rules (fewer than 50 words); line dedup may leave a text empty or short, which stays a
document and meets other empty ones in the next stage; of repeated rows one stays; documents with a null id are judged like
others and come last where an order decides; extra columns of any name are carried to the last stage; an empty table gives
an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import decontamination, line_dedup, near_copies, packing, quality_rules
from dialoom.llm.common import run_folder, table_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that (nearly) repeat an earlier line; n_chars follows the text."""
    return line_dedup.deduped(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8, candidates by the generalised pigeonhole
    over SimHash fingerprints (unequal thresholds by dynamic programming)."""
    return near_copies.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages."""
    return decontamination.cleaned(docs, table_of(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_free),
    ("packing", packed),
]

# Fuzzy lines, fingerprints and token ids can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table_of(spark, sf_dir, "documents")
    folder = f"{run_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
