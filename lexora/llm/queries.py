"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lexical, mixing, pivots
from .audio import store_audio, write_features
from .common import table
from .lm import lm_score
from .packing import pack_documents
from .periodic import find_runs, run_digests, with_planted_repeats
from .quality import judge
from .secrets import find_secrets
from .shards import write_shards
from .toxicity import score_toxicity
from .simhash import simhash_groups


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_ordered(table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_features(store_audio(table(spark, sf_dir, "documents")))


def op8_training_order_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(with_planted_repeats(table(spark, sf_dir, "documents"))))


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_chat_quotes": op3_chat_quotes,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_training_order_shards": op8_training_order_shards,
    "op9_lm_score": op9_lm_score,
    "op10_audio_features": op10_audio_features,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_search": op12_vector_search,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE = {
    "op2_mix_sources": mixing.SQL,
    "op3_chat_quotes": chat.SQL,
    "op12_vector_search": pivots.SQL,
    "op13_lexical_search": lexical.SQL,
}
