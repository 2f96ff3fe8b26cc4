"""Best-fit packing into fixed-length sequences, improved by swap-based local search.

Only the number of pieces of each length decides how pieces fit together, so the plan is made for
the histogram of lengths (at most ``capacity`` numbers, whatever the input's size): bins of equal
content are one pattern with a multiplicity. Best fit decreasing gives the first plan; local
search then moves, exchanges one for one, two for one or one for two between underfull patterns
whenever this increases the sum of squared fills, until the bins are as few as their sum allows
or no exchange improves. Pieces find their place by their rank among those of their length: ranks
come from counts of hashed groups, so no length, however common, is ranked in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import in_arrow, saved, texts

CAPACITY = 1024
END = 2
#: A group of pieces of one length that is ranked together holds about this part of all pieces, and GROUP at most.
PART = 1024
GROUP = 50_000

Plan = list[tuple[tuple[int, ...], int]]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones behind a first one that may be shorter."""
    n = -(-length // capacity)
    first = length - capacity * (n - 1)
    return [(0, first)] + [(first + capacity * i, capacity) for i in range(n - 1)]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit decreasing over a histogram of lengths: patterns of lengths with multiplicities."""
    room: dict[int, Counter] = defaultdict(Counter)
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        for r in range(length, capacity):  # the fullest bins first
            if left and room.get(r):
                k = r // length
                for pattern, m in sorted(room[r].items()):
                    whole = min(m, left // k)
                    part = left - whole * k if whole < m else 0
                    room[r][pattern] -= whole + (part > 0)
                    if not room[r][pattern]:
                        del room[r][pattern]
                    if whole:
                        room[r - k * length][pattern + (length,) * k] += whole
                    if part:
                        room[r - part * length][pattern + (length,) * part] += 1
                    left -= whole * k + part
                    if not left:
                        break
        k = capacity // length
        if left // k:
            room[capacity - k * length][(length,) * k] += left // k
        if left % k:
            room[capacity - left % k * length][(length,) * (left % k)] += 1
    return [(p, m) for r in sorted(room) for p, m in sorted(room[r].items())]


@lru_cache(maxsize=1 << 16)
def _takes(pattern: tuple[int, ...]) -> dict[int, tuple[int, ...]]:
    """Sums of one or two of a pattern's items, each with items that have it: one where one does."""
    kinds = sorted(set(pattern))
    out = {x: (x,) for x in kinds}
    n = Counter(pattern)
    for i, x in enumerate(kinds):
        for y in kinds[i:]:
            if (x != y or n[x] > 1) and x + y not in out:
                out[x + y] = (x, y)
    return out


def _without(pattern: tuple[int, ...], gone: tuple[int, ...], more: tuple[int, ...]) -> tuple[int, ...]:
    c = Counter(pattern)
    c.subtract(gone)
    c.update(more)
    return tuple(sorted(c.elements(), reverse=True))


class Holders:
    """Underfull patterns by the sums of one or two of their items, those of the least fill first."""

    def __init__(self):
        self.of: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    def add(self, p: tuple[int, ...]) -> None:
        for s in _takes(p):
            insort(self.of[s], (sum(p), p))

    def drop(self, p: tuple[int, ...]) -> None:
        for s in _takes(p):
            del self.of[s][bisect_left(self.of[s], (sum(p), p))]


def _exchange(p: tuple[int, ...], bins: Counter, holders: Holders, capacity: int):
    """(q, what p gives, what q gives) of the largest gain for p, or none: p grows, and more than q stays ahead."""
    fill = sum(p)
    gives = {0: ()} | _takes(p)
    for gain in range(capacity - fill, 0, -1):
        for s, give in gives.items():
            for other, q in holders.of.get(s + gain, ()):
                if fill - other + gain <= 0:
                    break  # holders further on are fuller
                take = _takes(q)[s + gain]
                if not (len(give) == 2 and len(take) == 2) and (q != p or bins[p] > 1):
                    return q, give, take
    return None


def local_search(plan: Plan, capacity: int = CAPACITY) -> Plan:
    """Raises the sum of squared fills by moves and exchanges between underfull bins; never adds a bin.

    The fullest underfull pattern looks for the largest gain that fits its gap. Every step moves as
    many equal bins at once as both sides have. Patterns that found nothing are asked again after
    the others have changed; the search ends when a whole round changes nothing, as it must: every
    step raises a bounded sum of whole numbers.
    """
    bins: Counter = Counter()
    for p, m in plan:
        bins[tuple(sorted(p, reverse=True))] += m
    holders = Holders()
    for p in bins:
        if sum(p) < capacity:
            holders.add(p)
    fuller = lambda p: (-sum(p), p)
    least, total = -(-sum(sum(p) * m for p, m in bins.items()) // capacity), sum(bins.values())

    def change(p: tuple[int, ...], m: int) -> None:
        before = bins[p]
        bins[p] += m
        if not bins[p]:
            del bins[p]
        if p and sum(p) < capacity and (before == 0) != (before + m == 0):
            (holders.add if before == 0 else holders.drop)(p)

    moved = True
    while moved and total > least:
        moved = False
        queue = [fuller(p) for p in bins if sum(p) < capacity]
        heapify(queue)
        waits = {p for _, p in queue}
        while queue and total > least:
            p = heappop(queue)[1]
            waits.discard(p)
            if p not in bins:
                continue
            found = _exchange(p, bins, holders, capacity)
            if not found:
                continue
            q, give, take = found
            m = bins[p] // 2 if q == p else min(bins[p], bins[q])
            change(p, -m)
            change(q, -m)
            grown, shrunk = _without(p, give, take), _without(q, take, give)
            change(grown, m)
            if shrunk:
                change(shrunk, m)
            else:
                total -= m
            moved = True
            for x in {grown, shrunk, p, q}:
                if x in bins and x not in waits and sum(x) < capacity:
                    waits.add(x)
                    heappush(queue, fuller(x))
    return sorted(bins.items(), key=lambda x: (-sum(x[0]), x[0]))


def slots(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places: (length << 40 | first rank, first sequence, offset, number), sorted by the first."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, m in plan:
        at = 0
        for x in pattern:
            rows.append(((x << 40) | rank[x], sequence, at, m))
            rank[x] += m
            at += x
        sequence += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def token_pieces(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, and the ids if asked."""
    path = path or tokens.default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for b in batches:
            owner, rows = [], []
            for i, text in enumerate(texts(b)):
                a = tokens.id_array(text, path, end)
                for k, (s, n) in enumerate(cut(len(a), capacity)):
                    raw = a[s : s + n].tobytes()
                    owner.append(i)
                    rows.append((k, s, n, zlib.crc32(raw)) + (raw,) * with_ids)
            c = list(zip(*rows)) or [()] * (4 + with_ids)
            arrays = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(c[0], pa.int32()), *(pa.array(x, pa.int64()) for x in c[1:4])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(x, pa.binary()) for x in c[4:]], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return in_arrow(docs.select("doc_id", "text"), run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length, ids_crc32) plus sequence_id and offset.

    Equal rows get places of their own. Every row needs 1 <= length <= capacity.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    group = min(GROUP, max(1, sum(counts.values()) // PART))
    plan = local_search(best_fit(counts, capacity), capacity)
    key, first, offset, _ = slots(plan)
    many = F.create_map(*[F.lit(x) for n, c in sorted(counts.items()) if c > group for x in (int(n), -(-c // group))]) if any(c > group for c in counts.values()) else None
    groups = F.lit(1) if many is None else F.coalesce(F.try_element_at(many, F.col("length").cast("int")), F.lit(1))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "piece", "start", "ids_crc32")]
    p = pieces.withColumn("group", F.pmod(F.xxhash64(*keys), groups.cast("long")).cast("int"))
    before = p.groupBy("length", "group").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("group")) - F.col("count")).drop("count")
    order = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = p.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "group"]).withColumn("rank", F.col("rank") + F.col("before")).drop("group", "before")
    names = pieces.columns

    def run(batches):
        for b in batches:
            n = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            r = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            want = (n.astype(np.int64) << 40) | r.astype(np.int64)
            at = np.searchsorted(key, want, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(first[at] + (want - key[at])), pa.array(offset[at])],
                [*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return in_arrow(ranked, run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and the end id; a null or empty text is the end id alone. Only
    documents above ``capacity`` are cut. Repeated rows are packed once each; null ids are kept.
    An empty table gives an empty result. Other columns are not read.
    """
    return place(saved(token_pieces(docs, path, end, capacity)), capacity)


def sequences(docs: DataFrame, path: str | None = None, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, length and ids (little-endian uint32); rows as pack_documents() says. A sequence gathers at most ``capacity`` pieces."""
    placed = place(saved(token_pieces(docs, path, end, capacity, with_ids=True)), capacity)
    joined = placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return joined.select("sequence_id", "length", F.concat_ws("", F.transform("x", lambda y: F.hex(y["ids"]))).alias("h")).select("sequence_id", "length", F.unhex("h").alias("ids"))
