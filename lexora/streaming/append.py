"""An index that grows by batches, merged when it is read.

A batch keeps its unfolded counts, their sums by form, and its documents' dates. Folding by case,
pruning of entities and of rare terms are of the whole, so they are done on reading, from the forms'
sums: however a corpus was cut into batches, the index is the one that build_index() makes of it.
Compaction adds up the batches so far. A manifest names the folders that count; it is committed
after them, so a reader sees whole batches only, and one that a failure repeats replaces itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, parse
from ..operators.joins import small
from ..plans import engine, storage
from ..plans.storage import Index

TABLES = ("counts", "forms", "dates")


def _changed(spark: SparkSession, path: str, change) -> int:
    """Commits change(the newest manifest's content), again if another writer was first; the number. A change that gives None changes nothing."""
    while True:
        number, content = storage.manifest(spark, path)
        new = change({"batches": {}, "base": [], "through": -1} | content)
        if new is None:
            return number
        try:
            return storage.commit(spark, path, new, number)
        except FileExistsError:
            continue


def write_batch(docs: DataFrame, number: int, path: str, stem: bool = True, **options) -> None:
    """Adds ``docs(doc_id, text[, created_at, url_terms])`` as batch ``number``, in place of an earlier one of that number. A null doc_id is not indexed."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull())
    name = f"v-{uuid.uuid4().hex}"
    parse.parse_counts(storage.spread(docs), "doc_id", **options).write.parquet(f"{path}/{name}/counts")
    counts = spark.read.parquet(f"{path}/{name}/counts")
    counts.groupBy("form", "kind").agg(F.sum("tf").alias("tf")).write.parquet(f"{path}/{name}/forms")
    engine.document_dates(docs).write.parquet(f"{path}/{name}/dates")

    def add(content: dict) -> dict | None:
        # a compacted batch that is repeated has the same rows
        return None if number <= content["through"] else content | {"batches": content["batches"] | {str(number): name}, "stem": stem}

    _changed(spark, path, add)


def append_postings(docs: DataFrame, path: str, checkpoint: str, stem: bool = True, **options):
    """Starts a query that adds each micro-batch of a stream ``docs(doc_id, text[, created_at, url_terms])`` and ends when all there is has been added."""
    write = lambda batch, number: write_batch(batch, number, path, stem, **options)
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _merged(spark: SparkSession, path: str, content: dict) -> dict[str, DataFrame]:
    """The tables of all that a manifest names, added up by form and by document; counts are as they were written."""
    folders = [*content["base"], *content["batches"].values()]
    read = {t: spark.read.parquet(*[f"{path}/{f}/{t}" for f in folders]) for t in TABLES}
    return {
        "counts": read["counts"],
        "forms": read["forms"].groupBy("form", "kind").agg(F.sum("tf").alias("tf")),
        "dates": read["dates"].groupBy("doc_id").agg(F.max("created_at").alias("created_at")),
    }


def compact(spark: SparkSession, path: str) -> int:
    """Adds up all batches into one set of tables; the manifest's number. Batches that come meanwhile stay beside it."""
    number, content = storage.manifest(spark, path)
    if not content.get("batches"):
        return number
    name, old = f"v-{uuid.uuid4().hex}", content["batches"]
    merged = _merged(spark, path, content)
    # texts that are documents of their own are kept as they are; what others add up to their documents' rows tell no more
    counts, several = merged["counts"], storage.written(index.unsure_documents(merged["counts"]))
    added = counts
    if several.limit(1).count():
        sums = [F.sum("tf").alias("tf"), F.sum("numbers").alias("numbers"), F.max("doc_length").alias("doc_length")]
        unknown = {"low": F.lit(False), "more": F.lit(0).cast("long"), "more_numbers": F.lit(0).cast("long"), "top": F.lit(None).cast("long"), "head": F.lit(False)}
        summed = counts.join(small(several), "doc_id", "left_semi").groupBy("doc_id", "form", "kind").agg(*sums).withColumns(unknown)
        added = counts.join(small(several), "doc_id", "left_anti").unionByName(summed)
    for t, rows in (merged | {"counts": added}).items():
        rows.write.parquet(f"{path}/{name}/{t}")

    def swap(now: dict) -> dict | None:
        if now["base"] != content["base"] or any(now["batches"].get(k) != v for k, v in old.items()):
            return None  # another compaction was first, or a batch was replaced
        return now | {"base": [name], "batches": {k: v for k, v in now["batches"].items() if k not in old}, "through": max(content["through"], *map(int, old))}

    return _changed(spark, path, swap)


def read_index(spark: SparkSession, path: str, least_df: int = 2, least_entity: int = 2, version: int | None = None) -> Index:
    """The index of all batches, or of those that an older manifest names."""
    number, content = storage.manifest(spark, path, version)
    if not number:
        raise FileNotFoundError(f"no batches at {path}")
    merged = _merged(spark, path, content)
    return engine.index_of_counts(merged["counts"], storage.written(merged["dates"]), merged["forms"], content["stem"], least_df, least_entity)


def read_postings(spark: SparkSession, path: str, least_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, postings) of all batches."""
    built = read_index(spark, path, least_df)
    return built.vocabulary, built.postings
