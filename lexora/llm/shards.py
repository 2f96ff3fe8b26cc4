"""Token-ID output in training order: a keyed Feistel permutation gives every sequence its global slot.

1. Every text's ids, an end id behind them, are written to a table once. From its lengths alone each
   document gets its place in one stream of all documents by doc_id, whatever the input's
   partitions: documents are dealt by range and counted, and the places lie in side files by input
   part, so the ids are not moved for it.
2. The stream is cut into sequences of ``length`` ids; only the last is filled with end ids. A
   sequence's slot is the permutation of its number: Feistel rounds on the least even number of
   bits that holds all numbers, walked along its cycle until it lies inside. It needs no table
   and no sort, and another key gives another order.
3. Partition k receives exactly the pieces of the slots of shard k, sorts them and writes one file of
   records of one size. Record r of shard k is slot k * per_shard + r, so a reader resumes at any
   slot by one seek. A shard is written under a name of the attempt's own and then renamed: a
   repeated task writes the same bytes to the same place.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import draw_of, file_system, in_arrow, passing_folder, share, shared_dir, texts, written

LENGTH = 1024
SHARDS = 1024
PER_SHARD = 1 << 14
MOST_PER_SHARD = 1 << 19
END = 50_256
GATHER = 64  # input parts whose documents' places share a folder
ROUNDS = 6
KEY = 0x5EED


def _round_keys(key: int) -> list[np.uint64]:
    out, x = [], key & 0xFFFFFFFFFFFFFFFF
    for _ in range(ROUNDS):  # splitmix
        x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        out.append(np.uint64(z ^ (z >> 27)))
    return out


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``index`` (or its inverse)."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)

    def mix(x, k):
        x = (x ^ k) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (x ^ (x >> np.uint64(29))) & mask

    def once(x):
        left, right = x >> half, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ mix(left, k), left
            else:
                left, right = right, left ^ mix(right, k)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(index).astype(np.uint64))
        while len(far := np.flatnonzero(out >= np.uint64(n))):
            out[far] = once(out[far])
    return out.astype(np.int64)


def _clear(target: str, shards: int) -> None:
    """Deletes from a finished target what failed attempts left, and an earlier run's shards beyond the last."""
    system, root = file_system(target)
    for f in system.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("shard-") and (not f.base_name.endswith(".bin") or int(f.base_name[6:-4]) >= shards):
            system.delete_file(f.path)


def _token_rows(docs: DataFrame, path: str, end: int) -> DataFrame:
    """row, doc_id, text_hash, n and ids (little-endian uint16, an end id behind them) of every row of ``docs``, as a written table.

    row tells the input part in its bits above 33, and the place in it below.
    """

    def run(batches):
        for b in batches:
            raw = [np.array(tokens.ids(t, path, plain=True) + [end], "<u2").tobytes() for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["row", "doc_id", "text_hash", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return written(in_arrow(src, run, f"row long, doc_id {kind}, text_hash long, n long, ids binary"), compression="zstd")


def _places(rows: DataFrame) -> str:
    """Writes row and start, the place of each document's first id in the stream, to side files: a folder for every GATHER input parts, and gives their folder's name.

    The stream's order is by doc_id, then by the text's hash; rows equal in both hold the same ids.
    """
    keys = ["doc_id", "text_hash", "row"]
    dealt = written(rows.select(*keys, "n").repartitionByRange(*keys).withColumn("r", F.spark_partition_id()))
    before = dealt.groupBy("r").agg(F.sum("n").alias("m"))  # a row a partition
    before = before.select("r", (F.sum("m").over(Window.orderBy("r")) - F.col("m")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("r").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = dealt.withColumn("own", own).join(F.broadcast(before), "r").select((F.shiftright("row", 33) / GATHER).cast("int").alias("g"), "row", (F.col("own") + F.col("before")).alias("start"))
    folder = passing_folder(rows.sparkSession, f"{shared_dir(rows.sparkSession)}/lexora-places/{uuid.uuid4().hex}")
    starts.repartition("g").sortWithinPartitions("g", "row").write.mode("overwrite").partitionBy("g").parquet(folder)
    return folder


def _starts_of(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts) of an input part, by row."""
    import pyarrow.parquet as pq

    system, root = file_system(folder)
    t = pq.read_table(f"{root}/g={part // GATHER}", columns=["row", "start"], filesystem=system, partitioning=None, filters=[("row", ">=", part << 33), ("row", "<", (part + 1) << 33)]).sort_by("row")
    return t.column(0).to_numpy(), t.column(1).to_numpy()


def _dictionary(rows: DataFrame, n_rows: int, length: int, sample: int = 2000) -> bytes:
    """What sequences have in common, of the first ids of about ``sample`` documents: pieces compress by it on their way to their shard."""
    import zstandard

    some = rows.where(draw_of("doc_id", "text_hash") < share(n_rows, sample)).select(F.substring("ids", 1, length * 2)).collect()
    some = [r[0] for r in some if len(r[0]) > 64]
    return zstandard.train_dictionary(1 << 16, some).as_bytes() if len(some) >= 500 else b""


class Deal:
    """Cuts documents into pieces of sequences. Documents that follow each other in the stream share a piece."""

    def __init__(self, folder: str, total: int, length: int, per_shard: int, key: int, common: bytes):
        self.folder, self.sequences, self.length, self.per_shard, self.key, self.common = folder, -(-total // length), length, per_shard, key, common

    def __call__(self, batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(self.common) if self.common else None)
        part, rows, starts, doc_type = None, None, None, pa.int64()
        held: list[bytes] = []  # of the open piece: it begins at first and ends at end of the stream
        first = end = 0
        doc, inside = None, 0  # whose ids it begins with, and where in them
        done: list[tuple] = []

        def close():
            nonlocal held
            if held:
                done.append((first // self.length, first % self.length, end - first, doc, inside, pack.compress(b"".join(held))))
            held = []

        def out():
            c = list(zip(*done)) or [()] * 6
            done.clear()
            sequence = np.array(c[0], np.int64)
            slot = permute(sequence, self.sequences, self.key)
            return pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array((slot // self.per_shard).astype(np.int32)), pa.array(sequence), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], doc_type), pa.array(c[4], pa.int64()), pa.array(c[5], pa.binary())],
                ["slot", "shard", "sequence", "at", "n_ids", "first_doc_id", "first_start", "ids"],
            )

        for b in batches:
            doc_type = b.column(1).type
            for row, doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if row >> 33 != part:
                    part = row >> 33
                    rows, starts = _starts_of(self.folder, part)
                raw, at = ids.as_py(), int(starts[np.searchsorted(rows, row)])
                used, n = 0, len(raw) // 2
                while used < n:
                    here = at + used
                    if not held or here != end or here % self.length == 0:
                        close()
                        first, doc, inside = here, doc_id, used
                    take = min(n - used, self.length - here % self.length)
                    held.append(raw[used * 2 : (used + take) * 2])
                    used += take
                    end = here + take
                if len(done) >= 4096:
                    yield out()
        close()
        yield out()


class Write:
    """Writes each shard's pieces, which come sorted, as records of one size, and gives a row a record, as read back."""

    def __init__(self, target: str, length: int, per_shard: int, end: int, common: bytes):
        self.target, self.length, self.per_shard, self.end, self.common = target, length, per_shard, end, common

    def __call__(self, batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.common) if self.common else None)
        system, root = file_system(self.target)
        stride, own = self.length * 2, f".{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        out, shard, rows, doc_type = None, None, [], None
        record = b""

        def flush():
            nonlocal record
            if record:
                rows[-1][2] = len(record) // 2
                out.write(record + np.full(self.length - len(record) // 2, self.end, "<u2").tobytes())
            record = b""

        def close():
            nonlocal rows
            flush()
            out.close()
            name = f"{root}/shard-{shard:06d}.bin"
            system.move(name + own, name)
            with system.open_input_stream(name) as f:  # read back in order
                crc = [zlib.crc32(f.read(stride)) for _ in rows]
            c = list(zip(*rows))
            rows = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array([shard] * len(crc), pa.int32()), pa.array([(s % self.per_shard) * stride for s in c[0]], pa.int64()), pa.array(c[2], pa.int32()), pa.array(crc, pa.int64()), pa.array(c[3], doc_type), pa.array(c[4], pa.int64())],
                ["slot", "sequence", "shard", "offset", "n_ids", "ids_crc32", "first_doc_id", "first_start"],
            )

        for b in batches:
            doc_type = b.schema.field("first_doc_id").type
            columns = [b.column(b.schema.get_field_index(n)).to_pylist() for n in ("slot", "shard", "sequence", "at", "first_doc_id", "first_start")]
            for slot, k, sequence, at, doc, inside, z in zip(*columns, b.column(b.schema.get_field_index("ids"))):
                if k != shard:
                    if out:
                        yield close()
                    shard = k
                    out = system.open_output_stream(f"{root}/shard-{shard:06d}.bin{own}")
                if at == 0:
                    flush()
                    rows.append([slot, sequence, 0, doc, inside])
                if not rows or rows[-1][0] != slot or at * 2 != len(record):
                    raise RuntimeError(f"a piece of sequence {sequence} is missing before id {at}")
                record += unpack.decompress(z.as_py())
        if out:
            yield close()


def shard_size(sequences: int) -> int:
    """Sequences a shard: about SHARDS shards, of PER_SHARD sequences at least and MOST_PER_SHARD (1 GiB of 1024 ids each) at most."""
    return max(PER_SHARD, min(MOST_PER_SHARD, 1 << (-(-sequences // SHARDS) - 1).bit_length()))


def write_shards(docs: DataFrame, target: str | None = None, path: str | None = None, end: int = END, length: int = LENGTH, per_shard: int | None = None, key: int = KEY) -> DataFrame:
    """Writes the shards and returns one row per sequence: slot, sequence, shard, offset, n_ids, ids_crc32, first_doc_id, first_start.

    The same rows give the same shards, in whatever order and partitions they come. offset is the
    record's byte place in its shard's file; n_ids excludes filling; ids_crc32 is of the record as
    read back. first_doc_id and first_start tell the document, and the place in its ids, at which
    the sequence begins. A null or empty text is the end id alone; null ids come first in the
    stream; repeated rows are written once each; an empty table writes no shard. Strings of special
    tokens in a text are ordinary text, so an end id ends a document. The rows are kept beside the
    shards, in manifest. ``target`` is a folder that all executors share (a URI that Arrow's file
    systems open), by default a new one under the shared folder, which goes with the application.
    What an earlier run or a failed attempt left there is deleted at the end.
    ``per_shard`` is shard_size() by default. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or tokens.default_path()
    target = target or passing_folder(spark, f"{shared_dir(spark)}/token_shards/{uuid.uuid4().hex}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _token_rows(docs, path, end)
    n_rows, total = rows.agg(F.count("*"), F.sum("n")).first()
    total = total or 0
    sequences = -(-total // length)
    per_shard = per_shard or shard_size(sequences)
    shards = -(-sequences // per_shard)
    system, root = file_system(target)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps({"sequences": int(sequences), "length": length, "dtype": "<u2", "per_shard": per_shard, "shards": shards, "key": key, "end": end}).encode())
    shape = f"slot long, sequence long, shard int, offset long, n_ids int, ids_crc32 long, first_doc_id {kind}, first_start long"
    if not total:
        _clear(target, 0)
        if system.get_file_info(f"{root}/manifest").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/manifest")
        return spark.createDataFrame([], shape)
    common = _dictionary(rows, n_rows, length)
    dealt = in_arrow(rows.select("row", "doc_id", "ids"), Deal(_places(rows), total, length, per_shard, key, common), f"slot long, shard int, sequence long, at int, n_ids int, first_doc_id {kind}, first_start long, ids binary")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot", "at")
    in_arrow(dealt, Write(target, length, per_shard, end, common), shape).write.mode("overwrite").parquet(f"{target}/manifest")
    _clear(target, shards)
    return spark.read.parquet(f"{target}/manifest")


def read_shards(target: str, slot: int = 0):
    """Yields (slot, ids) in training order from ``slot`` on; one seek, then sequential reads."""
    system, root = file_system(target)
    with system.open_input_stream(f"{root}/layout.json") as f:
        layout = json.loads(f.read())
    stride, per = layout["length"] * 2, layout["per_shard"]
    while slot < layout["sequences"]:
        with system.open_input_file(f"{root}/shard-{slot // per:06d}.bin") as f:
            f.seek(slot % per * stride)
            while slot < layout["sequences"]:
                raw = f.read(stride)
                if not raw:
                    break
                yield slot, np.frombuffer(raw, layout["dtype"])
                slot += 1
