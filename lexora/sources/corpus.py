"""Readers and the result writer."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import post_time
from ..functions.rules import keep_latin
from ..functions.urls import concat_post, domain_terms, post_urls
from .schemas import POST, POST_FIELDS

log = logging.getLogger(__name__)


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Posts of all files ending .parquet below root. Columns go by name, or else by place; no file at all is an empty corpus."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        raw = reader.parquet(root)
    except Exception as e:  # no parquet file below root
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], POST)
    if not set(POST_FIELDS) <= set(raw.columns):
        raw = raw.toDF(*POST_FIELDS, *raw.columns[len(POST_FIELDS) :])
    return raw.select(*[F.col(n).cast("string").alias(n) for n in POST_FIELDS])


def read_file(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Posts of one file: an absolute path or URI, or one below root."""
    return read_corpus(spark, name if name.startswith("/") or "://" in name else f"{root.rstrip('/')}/{name}")


def posts_to_corpus(posts: DataFrame, include_retweet_text: bool = False) -> DataFrame:
    """doc_id, created_at, text (joined and filtered to Latin letters) and url_terms of each post."""
    urls = post_urls(F.col("full_text"), F.col("urls"), F.col("retweet_urls"), F.col("quote_urls"), F.col("retweet_quoted_urls"))
    text = concat_post(F.col("full_text"), F.col("retweet_quoted_text"), F.col("quoted_text"), F.col("retweet_text") if include_retweet_text else None)
    return posts.select(F.col("post_id").try_cast("long").alias("doc_id"), post_time(F.col("created")).alias("created_at"), keep_latin(text).alias("text"), domain_terms(urls).alias("url_terms"))


def parse_query_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """query_num, text and malformed of lines '<number>.<text>': text follows the first dot. Blank lines are skipped; lines without a dot are reported as malformed, not searched."""
    line = F.regexp_replace(F.col(column), r"[\r\n]+$", "")
    out = lines.where(line != "").select(F.regexp_extract(line, r"^([^.]*)\.", 1).try_cast("long").alias("query_num"), F.regexp_extract(line, r"^[^.]*\.(.*)$", 1).alias("text"), (~line.contains(".")).alias("malformed"))
    return out


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a query file that are not searched: those without a dot."""
    line = F.regexp_replace("value", r"[\r\n]+$", "")
    return spark.read.text(path).where((line != "") & ~line.contains(".")).select(line.alias("line"))


def read_queries(spark: SparkSession, path: str, shown: int = 20) -> DataFrame:
    """query_num and text of a query file. Numbers are those of its lines. Malformed lines are not searched but reported: how many there are, and the first ``shown``."""
    bad = malformed_lines(spark, path)
    if n := bad.count():
        log.warning("%s: %s malformed lines are not searched, such as %s", path, n, [r["line"][:200] for r in bad.limit(shown).collect()])
    return parse_query_lines(spark.read.text(path)).where(~F.col("malformed")).select("query_num", "text")


def query_list(spark: SparkSession, queries: Iterable[str]) -> DataFrame:
    """query_num from 1 and text."""
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries, 1)], "query_num long, text string")


def write_results(results: DataFrame, path: str) -> None:
    """One CSV file with a header: query number, document, score; at most the top results of each query."""
    out = results.orderBy("query_num", "rnk").select(F.col("query_num").alias("Query_num"), F.col("doc_id").alias("Tweet_id"), F.col("score").alias("Rank"))
    out.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
