"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints are kept as vertical bit planes: word w of plane b holds bit b of 64 fingerprints.
One pass of XORs over the planes advances 64 distances at once; they are counted by carry-save
bitwise counters (ones, twos and a sticky "beyond the radius" plane), and a block of 64 is left
as soon as all its distances have passed the radius.

Which fingerprints meet: 64 bits are cut into five blocks. Two fingerprints that differ in at
most three bits agree on at least two blocks, so all links lie inside the ten tables keyed by
a pair of blocks (about 26 bits). A key with more than ``tile`` fingerprints is dealt into tiles
and each pair of tiles is a task of its own, so no key is a bottleneck and none is cut short.
Inside a task links are contracted at once to stars, so a group of n near copies costs n links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_read, by_part, components, in_arrow, lower_words, rows_of_part, saved, texts

RADIUS = 3
SHINGLE = 3
SEED = 42
#: (first bit, width) of the five blocks.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, chunk: int = 1 << 15) -> int:
    """64-bit SimHash of the text's 3-word shingles (repeats count), as an unsigned integer.

    A bit is 1 if it is set in over half the shingle hashes. No words: zero. Fewer than three
    words: the sequence itself is the one shingle. Long texts are counted in chunks.
    """
    w = lower_words(text or "")
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    join, digest, n = b" ".join, xxhash.xxh64_intdigest, len(w) - SHINGLE + 1
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        part = w[at : at + chunk + SHINGLE - 1]
        h = np.fromiter((digest(join(x), SEED) for x in zip(part, part[1:], part[2:])), np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit i of word w of plane b is bit b of value 64 * w + i; the rest is zero."""
    rows = np.zeros(-len(values) % 64 + len(values), np.uint64)
    rows[: len(values)] = values
    bits = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _count(differ, alive: np.ndarray, first: int = 24, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save count of differing planes; ``differ(b, alive)`` gives plane b for the alive blocks, at first those given.

    Returns the indices of the blocks that stayed alive and, for each, the word whose set bits
    are within RADIUS (3: the two counter planes have not overflowed).
    """
    ones = twos = over = np.zeros(len(alive), np.uint64)
    for b in range(64):
        d = differ(b, alive)
        carry = ones & d
        ones = ones ^ d
        over = over | (twos & carry)
        twos = twos ^ carry
        if b >= first and (b - first) % step == 0:
            stay = np.flatnonzero(over != ONES)
            if len(stay) < len(alive):
                alive, ones, twos, over = alive[stay], ones[stay], twos[stay], over[stay]
                if not len(alive):
                    break
    return alive, ~over


def near_pairs(left: np.ndarray, right: np.ndarray | None = None, queries: int = 128):
    """Yields index arrays (i, j): left[i] and right[j] differ in at most RADIUS bits.

    Without right, left meets itself, and only blocks that hold a j above i are compared.
    """
    right, same = (left, True) if right is None else (right, False)
    planes = bit_planes(right)
    width = planes.shape[1]
    for at in range(0, len(left), queries):
        q = left[at : at + queries]
        flip = [np.where((q >> np.uint64(b)) & np.uint64(1), ONES, np.uint64(0)) for b in range(64)]
        blocks = np.arange(len(q) * width)
        if same:
            blocks = blocks[blocks % width >= (at + blocks // width + 1) // 64]
        alive, within = _count(lambda b, k: planes[b][k % width] ^ flip[b][k // width], blocks)
        if len(alive):
            hit = np.unpackbits(within.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
            block, bit = np.nonzero(hit)
            j = (alive[block] % width) * 64 + bit
            i = at + alive[block] // width
            ok = (j < len(right)) & ((j > i) if same else True)
            yield i[ok], j[ok]


def near_in_runs(values: np.ndarray, run: np.ndarray, longest: int):
    """Yields (i, j) within RADIUS where both lie in the same run; for runs of up to ``longest`` values."""
    for s in range(1, longest):
        i = np.flatnonzero(run[s:] == run[:-s])
        if not len(i):
            break
        planes = bit_planes(values[i] ^ values[i + s])
        alive, within = _count(lambda b, k: planes[b][k], np.arange(planes.shape[1]))
        hit = np.unpackbits(within.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
        block, bit = np.nonzero(hit)
        k = alive[block] * 64 + bit
        k = i[k[k < len(i)]]
        yield k, k + s


class Forest:
    """Union-find over 0..n-1; the root is the least index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(x) for x in range(len(self.up))], np.int64)
        own = np.flatnonzero(roots != np.arange(len(roots)))
        return own, roots[own]


def _links_of(values: np.ndarray, tiles: np.ndarray, run: np.ndarray, small: int = 32):
    """Star links (u, v) as fingerprints, for rows sorted by run; two tiles in a run meet each other only."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.r_[starts[1:], len(run)]
    forest = Forest(len(values))
    few = np.repeat(ends - starts <= small, ends - starts)
    for s, e in zip(starts[ends - starts > small].tolist(), ends[ends - starts > small].tolist()):
        a, kinds = values[s:e], np.unique(tiles[s:e])
        left = np.flatnonzero(tiles[s:e] == kinds[0])
        right = left if len(kinds) == 1 else np.flatnonzero(tiles[s:e] != kinds[0])
        for i, j in near_pairs(a[left], None if len(kinds) == 1 else a[right]):
            forest.link(s + left[i], s + right[j])
    where = np.flatnonzero(few)
    if len(where):
        for i, j in near_in_runs(values[where], run[where], small):
            forest.link(where[i], where[j])
    u, v = forest.stars()
    return values[u], values[v]


def _links(batches, limit: int = 1 << 16):
    """Whole runs at a time, as long as the next batch continues the last one."""
    held = None

    def out(x):
        fp, tile, run = x
        u, v = _links_of(fp, tile, run)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    last, number = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
        if last is not None:
            new[0] = bool((keys[0] != last).any())
        last = keys[-1]
        run = number + np.cumsum(new)
        number = int(run[-1])
        x = (b.column(4).to_numpy(zero_copy_only=False).view(np.uint64), b.column(5).to_numpy(zero_copy_only=False), run)
        held = x if held is None else tuple(np.concatenate(p) for p in zip(held, x))
        if len(held[0]) >= limit:
            cut = int(np.searchsorted(held[2], held[2][-1]))
            if cut:
                yield out(tuple(p[:cut] for p in held))
                held = tuple(p[cut:] for p in held)
    if held is not None and len(held[0]):
        yield out(held)


def near_links(prints: DataFrame, tile: int = 8192) -> DataFrame:
    """All links between the distinct fingerprints ``prints(fp)``, contracted to stars per task: ``(u, v)``."""
    keys = []
    for c, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        (a, wa), (b, wb) = BLOCKS[i], BLOCKS[j]
        part = lambda at, w: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1))
        keys.append(F.lit(c << 32) + F.shiftleft(part(a, wa), 13) + part(b, wb))
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, "key").select("key", "fp", F.ceil(F.col("n") / tile).cast("int").alias("t"))
    met = met.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("t")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    met = met.select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), F.pmod(F.hash("key", F.least("tile", "other"), F.greatest("tile", "other")), F.lit(1 << 20)).alias("deal"), "fp", "tile")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(met.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b"), _links, "u long, v long")


def _prints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, text_hash, root.

    component_id is the smallest doc_id reachable over links of at most three differing bits.
    A null or empty text has fingerprint zero and is linked like any other. Repeated rows and ids
    give repeated rows. A row with a null id is grouped but never names a group; a group of null
    ids alone has a null component_id (root still identifies it). Other columns are not read.
    """
    ids = docs.schema[doc_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"), F.monotonically_increasing_id().alias("row_number"))
    fps = saved(in_arrow(src, _prints, f"doc_id {ids}, fp long, text_hash long, row_number long"))
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(near_links(nodes.select("fp")))
    rooted = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(named, "root").select("fp", "root", "component_id")
    return fps.join(rooted, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root", "row_number")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each SimHash group: the one that names it (least doc_id, a null one last, then least text hash, of equal rows one).

    Null and empty texts are one group, as their fingerprint is. No text is shuffled: the numbers of
    the rows that stay go to side files by input part, and each part is read again and filtered in
    its place. A row that is not the one that was numbered is an error. An empty table stays empty.
    """
    docs = as_read(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row_number")
    first = simhash_groups(docs).groupBy("root").agg(F.min(order).alias("x"))
    folder = by_part(first.select(F.col("x.row_number").alias("row"), F.col("x.text_hash").alias("text_hash")))
    names = docs.columns

    def run(batches):
        kept = hashes = None
        for b in batches:
            row, text_hash = (b.column(len(names) + k).to_numpy() for k in (0, 1))
            if not len(row):
                continue
            if kept is None:  # a task's rows are of one input part
                t = rows_of_part(folder, int(row[0]) >> 33)
                kept, hashes = (t.column(c).to_numpy() if t.num_rows else np.zeros(0, np.int64) for c in ("row", "text_hash"))
                done = 0
            lo, hi = np.searchsorted(kept, (row[0], row[-1] + 1))
            place = kept[lo:hi] - row[0]
            done += int(hi - lo)
            if row[-1] - row[0] + 1 != len(row) or (text_hash[place] != hashes[lo:hi]).any():
                raise RuntimeError("the rows came in another order than before")
            yield pa.RecordBatch.from_arrays(b.take(pa.array(place)).columns[: len(names)], names)
        if kept is not None and done != len(kept):
            raise RuntimeError("rows that were numbered did not come again")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return in_arrow(docs.select(*names, F.monotonically_increasing_id().alias("row number"), F.xxhash64("text").alias("hash of the text")), run, schema)
