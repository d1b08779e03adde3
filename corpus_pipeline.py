"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import shared_dir, table
from tessella.llm.decontaminate import decontaminate
from tessella.llm.near_copies import drop_near_copies
from tessella.llm.packing import pack
from tessella.llm.pii import redact
from tessella.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, at least 0.8 of them shared."""
    return drop_near_copies(docs)


def clear_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to the name of its kind."""
    return redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths, one a sequence. The workers serve other stages too, so the word cache is smaller and ends
    with its partition."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=240_000, keep_cache=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_dedup", deduplicate),
    ("decontaminate", clear_benchmark),
    ("pii", hide_personal),
    ("packing", sequences),
]

#: Learned rules, fingerprints and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark).rstrip('/')}/tessella/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
