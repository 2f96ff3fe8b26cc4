"""The corpus pipeline: documents through quality rules, near-dedup, secret scans, mixing and packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexora.llm.common import passing_folder, shared_dir, table
from lexora.llm.mixing import mixed_documents
from lexora.llm.packing import pack_documents
from lexora.llm.quality import keep_good
from lexora.llm.secrets import find_secrets
from lexora.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text is rejected; equal rows are kept or rejected together."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id, of equal rows one; a null id comes last. Null and empty texts are one group."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced and n_chars counted anew. A null text stays null, with a null n_chars; equal rows stay equal."""
    return find_secrets(docs, redact=True).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it. A null source is one of its own; equal rows are drawn alike; of size 0 a text is taken with its source's whole repetitions."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences. A null or empty text is one end id; equal rows are packed once each."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Several stages fit models and compare fingerprints: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what one keeps is written to the shared folder and read by the next. An empty table gives an empty result; the folder goes with the application."""
    docs = table(spark, sf_dir, "documents")
    folder = passing_folder(spark, f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{k}_{name}")
            docs = spark.read.parquet(path)
    return docs
