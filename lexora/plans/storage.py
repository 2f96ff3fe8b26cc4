"""The index on disk: versions of Parquet tables below one folder, each named by a manifest that is committed last. And tables written between steps."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..operators.sentences import Sentences
    from .blocks import Blocks

LOOKUP_TERMS = 10_000
#: The end of a manifest that was written whole.
END = "\n--\n"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the cluster names none, a temporary one serves a local master, and no other."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.gettempdir().rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one; the file system deletes it when the application ends."""
    folder = f"{shared_root(spark)}/lexora-index/{uuid.uuid4().hex}"
    system, path = _path(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    system, path = _path(spark, folder)
    system.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in a folder of its own: computed once, short plans for what reads it, and no loss with an executor."""
    path = new_folder(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt anew where it is so small that its files make fewer tasks than there are cores: work on texts would leave cores idle.

    The plan's own estimate of its bytes tells, so nothing is run for it; more than a few MB a core stays as it is.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() else docs


@dataclass
class Index:
    """vocabulary(term, df), postings(term, doc_id, tf, ntf), doc_stats(doc_id, doc_length, max_tf, created_at), stats(n_docs, n_numbers, stem).

    A saved one has deletions(d, term, df) too, the keys of its spellings, and one whose sentences were learned their model.
    One saved in blocks has those, and its postings are what they unfold to. One that was built may tell what its postings
    are made of, frequencies(term, doc_id, tf, ntf), a written table, and in how many documents a term of theirs is at least.
    """

    vocabulary: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    stats: DataFrame
    deletions: DataFrame | None = None
    sentences: Sentences | None = None
    blocks: Blocks | None = None
    frequencies: DataFrame | None = None
    least_df: int = 2

    def n_docs(self) -> int:
        return int(self.stats.first()["n_docs"])


# ---------------------------------------------------------------- versions


def commit(spark: SparkSession, path: str, content: dict, after: int | None = None) -> int:
    """Makes content the folder's newest manifest; its number. With ``after``, only if that is still the newest's: else FileExistsError, and nothing has changed.

    A manifest is one small file, named by its number and never overwritten; it comes last, so what
    it names is whole. One that was cut off in writing has no end mark and is not read.
    """
    system, folder = _path(spark, f"{path}/manifests")
    system.mkdirs(folder)
    number = (manifest(spark, path)[0] if after is None else after) + 1
    while True:
        try:
            out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number}.json"), False)
            break
        except Exception as e:  # another writer was first
            if "already exists" not in str(e):
                raise
            if after is not None:
                raise FileExistsError(f"{path} has a manifest {number}") from None
            number += 1
    out.write(bytearray((json.dumps(content) + END).encode()))
    out.close()
    return number


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(number, content) of a folder's newest whole manifest, or of one by number; (0, {}) if there is none."""
    system, folder = _path(spark, f"{path}/manifests")
    if not system.exists(folder):
        return 0, {}
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    numbers = sorted((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), reverse=True)
    for n in numbers if version is None else [n for n in numbers if n == version]:
        text = "".join(r[0] for r in spark.read.text(f"{path}/manifests/{n}.json", wholetext=True).collect())
        if text.endswith(END):
            return n, json.loads(text[: -len(END)])
    if version is not None:
        raise FileNotFoundError(f"{path} has no version {version}")
    return 0, {}


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the tables that none of the newest ``keep`` manifests names, and the older manifests. Readers of those versions, and writers that have not committed, must be done."""
    system, folder = _path(spark, path)
    newest, _ = manifest(spark, path)
    kept = {d for n in range(max(1, newest - keep + 1), newest + 1) for d in _folders(manifest(spark, path, n)[1])}
    gone = [f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in kept]
    for n in range(1, newest - keep + 1):
        delete(spark, f"{path}/manifests/{n}.json")
    for name in gone:
        delete(spark, f"{path}/{name}")
    return gone


def _folders(content: dict) -> list[str]:
    return list(content.get("tables", {}).values()) + list(content.get("batches", {}).values()) + list(content.get("base", []))


MODEL = ("abbreviations", "starters", "collocations", "decisions")


def save(index: Index, path: str, postings_per_file: int = 2_000_000, in_blocks: bool = False) -> int:
    """A new version of the index at path; its number. Readers see it once it is whole, those of an older version keep theirs.

    Terms' postings lie together and in order, so that a lookup's terms prune row groups by their
    bounds; so do the vocabulary's deletions. Postings are computed once: what range partitions
    sample is a written table, the frequencies they are made of if the index tells. ``in_blocks`` stores posting lists in blocks with bounds, by buckets.
    """
    from ..operators.correct import deletion_table
    from ..operators.index import ordered_postings
    from . import blocks

    spark = index.stats.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    in_order = lambda df, *keys: df.repartitionByRange(*keys).sortWithinPartitions(*keys).write
    vocabulary = written(index.vocabulary)
    in_order(vocabulary, "term").parquet(f"{folder}/vocabulary")
    in_order(deletion_table(vocabulary), "d", "term").parquet(f"{folder}/deletions")
    layout = None
    if in_blocks:
        layout = blocks.save(written(index.postings), folder, postings_per_file)
    elif index.frequencies is not None:
        for rows in ordered_postings(index.frequencies, vocabulary, index.least_df):
            rows.write.mode("append").option("maxRecordsPerFile", postings_per_file).parquet(f"{folder}/postings")
    else:
        in_order(written(index.postings), "term", "doc_id").option("maxRecordsPerFile", postings_per_file).parquet(f"{folder}/postings")
    index.doc_stats.write.parquet(f"{folder}/doc_stats")
    index.stats.coalesce(1).write.parquet(f"{folder}/stats")
    for part in MODEL if index.sentences is not None else ():
        getattr(index.sentences, part).write.parquet(f"{folder}/{part}")
    return commit(spark, path, {"tables": {"index": name}, "sentences": index.sentences is not None, "blocks": layout})


def load(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The newest version of the index at path, or one by number. What is loaded stays as it is, whatever is saved later."""
    number, content = manifest(spark, path, version)
    if not number:
        raise FileNotFoundError(f"no index at {path}")
    from . import blocks

    folder, layout = f"{path}/{content['tables']['index']}", content.get("blocks")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    model = None
    if content["sentences"]:
        from ..operators.sentences import Sentences, decision_sets

        model = Sentences(*[read(part) for part in MODEL])
        model.sets = decision_sets(model)
    lists = blocks.load(spark, folder, layout) if layout else None
    postings = blocks.unfold(lists.rows) if lists else read("postings")
    return Index(read("vocabulary"), postings, *[read(name) for name in ("doc_stats", "stats", "deletions")], sentences=model, blocks=lists)


def lookup(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of the terms: a pushed IN filter for up to LOOKUP_TERMS distinct ones, else a join; lists in blocks are not exchanged for it."""
    if index.blocks is not None:
        from . import blocks

        return blocks.unfold(blocks.of_terms(index.blocks, terms, LOOKUP_TERMS))
    some = [r[0] for r in terms.select("term").distinct().limit(LOOKUP_TERMS + 1).collect()]
    if len(some) <= LOOKUP_TERMS:
        return index.postings.where(F.col("term").isin(some))
    return index.postings.join(terms.select("term").distinct(), "term", "left_semi")
