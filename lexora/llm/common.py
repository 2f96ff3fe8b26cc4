"""Pieces that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: A small side is broadcast up to this many rows; beyond it the join is a salted shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text that are cut into words at a time.
PIECE = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, the checkpoints' too. Where the cluster names none, a temporary one serves a local master, and no other."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or passing_folder(spark, tempfile.mkdtemp(prefix="lexora-")))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def passing_folder(spark: SparkSession, folder: str) -> str:
    """folder, made if need be; its file system deletes it when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def file_system(target: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder's URI or path, and the folder's path in it."""
    if "://" not in target:
        target = target.replace("file:", "file://", 1) if target.startswith("file:") else f"file://{target}"
    return fs.FileSystem.from_uri(target)


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a Parquet table in a folder of its own below the shared one: computed once, and read by columns."""
    spark = df.sparkSession
    folder = passing_folder(spark, f"{shared_dir(spark)}/lexora-tables/{uuid.uuid4().hex}")
    df.write.mode("overwrite").options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by a reliable checkpoint, whose files go when the application ends."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        passing_folder(spark, file.get())
    return out


#: Input parts whose rows of a side table lie in one folder.
GATHER = 64


def _reader(folder: str):
    """(pyarrow's file system of a folder, the path in it)."""
    from pyarrow import fs

    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    return fs.FileSystem.from_uri(folder)


def as_read(docs: DataFrame) -> DataFrame:
    """docs as a frame that has the same rows in the same partitions and order each time it is read: itself, or a written table if it comes from an exchange."""
    return written(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def by_part(side: DataFrame) -> str:
    """Writes ``side(row, ...)`` by the input part that ``row``, a monotonically_increasing_id(), tells, and gives the folder's name."""
    spark = side.sparkSession
    folder = passing_folder(spark, f"{shared_dir(spark)}/lexora-parts/{uuid.uuid4().hex}")
    side = side.withColumn("g", (F.shiftright("row", 33) / GATHER).cast("int"))
    side.repartition("g").sortWithinPartitions("g", "row").write.mode("overwrite").partitionBy("g").parquet(folder)
    return folder


def rows_of_part(folder: str, part: int) -> pa.Table:
    """The side table's rows of one input part, by row; none if it has none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = _reader(folder)
    root = f"{root}/g={part // GATHER}"
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return pa.table({})
    t = pq.read_table(root, filesystem=system, partitioning=None, filters=[("row", ">=", part << 33), ("row", "<", (part + 1) << 33)])
    return t.sort_by("row")


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers find this package where the driver has it (elsewhere, ship it with --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as strings; a null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def words(text: str) -> list[bytes]:
    """UTF-8 words of the text in its own case: bytes.split() parts at exactly x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_words(text: str) -> list[bytes]:
    """As words(), with A-Z alone lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in record batches of less than ``size`` bytes of text after their first row."""
    for b in batches:
        at = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.r_[0, np.flatnonzero(np.diff(at // size)) + 1, len(at)].tolist() if len(at) else []
        for s, e in zip(cuts, cuts[1:]):
            yield b.slice(s, e - s)


def word_parts(piece: pa.RecordBatch, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """(where each text's parts begin, and the end; the parts): its words, A-Z lowered if asked. Blanks at a text's ends leave empty parts, a null is the empty text."""
    text = piece.column(piece.schema.get_field_index("text")).cast(pa.string()).fill_null("")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    return parts.offsets.to_numpy(), parts.values


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n


def draw_of(*columns) -> Column:
    """A uniform draw from 0 to 2**31 - 1 by the columns' hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31))


def share(rows: int, bound: int) -> int:
    """The draws below which about ``bound`` of ``rows`` rows lie: a sample costs a filter, and no task returns more than its part."""
    return 1 << 31 if rows <= bound else -(-(1 << 31) * bound // rows)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS, salt: int = 64) -> DataFrame:
    """Null-safe equi-join with a side that is nearly always small.

    The small side is counted first: up to ``limit`` rows it is broadcast, beyond that both
    sides are shuffled on the keys and a salt, so that one hot key spreads over ``salt`` tasks.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    small = small.withColumnsRenamed(dict(zip(keys, names)))
    on = [big[k].eqNullSafe(small[n]) for k, n in zip(keys, names)]
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how).drop(*names)
    spread = F.pmod(F.xxhash64(*[big[c] for c in big.columns if c not in keys]), F.lit(salt))
    big = big.withColumn("__salt", spread.cast("int"))
    small = small.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    on = [big[k].eqNullSafe(small[n]) for k, n in zip(keys, names)] + [big["__salt"] == small["__salt2"]]
    return big.join(small, on, how).drop(*names, "__salt", "__salt2")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (long ids) as ``(node, root)``; root is the least id of the component.

    Alternating large-star and small-star contraction: every round is two aggregations and two
    equi-joins, and each is checkpointed. A hub's rows meet only in joins whose large
    partitions can be split. Null ends and self-loops are ignored.
    """
    e = saved(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = saved(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

