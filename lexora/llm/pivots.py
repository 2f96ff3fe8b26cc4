"""Exact top-k search by inner product, with a table of angles to pivots that rules candidates out.

The angle between vectors is a metric on directions, so for every pivot p an angle(q, x) is at least
|angle(q, p) - angle(x, p)|; the largest of these over many pivots bounds a score from above by
|q| |x| cos(bound). Angles of all rows to all pivots are computed once and kept beside the vectors.

Rows are dealt into segments of bounded bytes by their nearest pivot, large ones split by hash. A
query first meets its own segment, where its neighbours are likely; its k-th best score there goes
with it to every segment. There candidates whose bound is below that score fall away, a few pivots
at a time; the others are scored in the order of their bounds until the next bound is below the
k-th best. Bounds that equal it are scored, so ties are whole. Queries are copied to the segments,
never rows to the queries, and no task holds more than one segment and one batch of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import draw_of, in_arrow, share, written

#: Bytes of a segment's vectors in a task, about; rows that pivots are chosen from.
SEGMENT = 1 << 25
SAMPLE = 2000
#: A segment has at most a share of all rows, or so many, even where its bytes allow more.
EVEN, LEAST_ROWS = 64, 1024
#: Pivots that are asked at a time, and candidates scored at first.
STEP = 8
FIRST = 128
#: What rounding may take from an angle, and from a bound by its size.
SLACK = 1e-6
NO_SCORE = -(1 << 63)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as int64 rows, shorter ones filled up with zeros."""
    ends = lists.offsets.to_numpy()
    n = np.diff(ends)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return out


def angles(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms of x, angles of its rows to those of p). A zero vector is at angle 0 to all."""
    x, p = x.astype(np.float64), p.astype(np.float64)
    nx, np_ = np.sqrt((x * x).sum(axis=1)), np.sqrt((p * p).sum(axis=1))
    unit = x / np.where(nx, nx, 1)[:, None]
    cos = np.where((nx[:, None] > 0) & (np_ > 0), unit @ (p / np.where(np_, np_, 1)[:, None]).T, 1.0)
    return nx, np.arccos(np.clip(cos, -1, 1))


def choose(sample: np.ndarray, many: int) -> np.ndarray:
    """Up to ``many`` rows of the sample, each the farthest in angle from those before it."""
    if not len(sample):
        return sample
    at, least = [0], angles(sample, sample[:1])[1][:, 0]
    while len(at) < many and least.max() > SLACK:
        at.append(int(least.argmax()))
        least = np.minimum(least, angles(sample, sample[at[-1:]])[1][:, 0])
    return sample[at]


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products of x's rows with q: in doubles where these hold every sum, else in 64-bit integers."""
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if largest < 1 << 52 else x @ q


class Segment:
    """Rows of a segment with their angles; counts what it scores."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, table: np.ndarray):
        self.ids, self.x, self.norms = ids, x, norms
        self.table = np.ascontiguousarray(table.T)
        # doubles hold the rows' products with a query of no larger components
        self.largest = float(np.abs(x).max(initial=0))
        self.fast = x.astype(np.float64) if self.largest**2 * max(1, x.shape[1]) < 1 << 52 else None
        self.scored = 0

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        if self.fast is not None and float(np.abs(q).max(initial=0)) <= self.largest:
            return (self.fast[at] @ q.astype(np.float64)).astype(np.int64)
        return dots(self.x[at], q)

    def best(self, k: int, own: int, q: np.ndarray, norm: float, angle: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows whose score is ``least`` or more, best first, equal ones by id; rows with the query's own id are left out."""
        at = np.flatnonzero(self.ids != own)
        reach = self.norms[at] * norm
        slack = 1 + SLACK * reach
        # the angle beyond which a candidate's score is below least
        widest = np.arccos(np.clip((least - slack) / np.where(reach > 0, reach, 1), -1, 1)) + SLACK if least > NO_SCORE else np.full(len(at), np.inf)
        widest[reach + slack < least] = -1
        lower = np.zeros(len(at))
        for s in range(0, len(angle), STEP):
            part = self.table[s : s + STEP]
            gap = np.abs((part if len(at) == part.shape[1] else part[:, at]) - angle[s : s + STEP, None]).max(axis=0)
            np.maximum(lower, gap, out=lower)
            alive = lower <= widest
            if not alive.all():
                at, lower, widest = at[alive], lower[alive], widest[alive]
        bound = self.norms[at] * norm
        bound = bound * np.cos(np.clip(lower - SLACK, 0, np.pi)) + 1 + SLACK * bound
        scores, ids, size = np.zeros(0, np.int64), np.zeros(0, np.int64), FIRST
        while len(at):
            head = np.argpartition(-bound, size - 1)[:size] if len(at) > size else np.arange(len(at))
            scores, ids = np.r_[scores, self.scores(at[head], q)], np.r_[ids, self.ids[at[head]]]
            good = scores >= least
            scores, ids = scores[good], ids[good]
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
            rest = np.ones(len(at), bool)
            rest[head] = False
            rest &= bound >= least
            at, bound, size = at[rest], bound[rest], size * 2
        return scores, ids


def _columns(b: pa.RecordBatch, width: int):
    """(ids, vectors, norms, angles) of a batch of table rows."""
    table = b.column("angles")
    n = b.num_rows
    flat = table.values.to_numpy()[table.offsets[0].as_py() : table.offsets[n].as_py()] if n else np.zeros(0)
    return b.column("vec_id").to_numpy(), matrix(b.column("v"), width), b.column("norm").to_numpy(), flat.reshape(n, -1).astype(np.float64)


def _segments(batches):
    """(segment's number, its rows as one record batch) of rows that lie by segment."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        seg = b.column("seg").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(seg)) + 1, len(seg)].tolist() if len(seg) else []
        for lo, hi in zip(cuts, cuts[1:]):
            part = b.slice(lo, hi - lo)
            if held and held[0].column("seg")[0] != part.column("seg")[0]:
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def nearest(vectors: DataFrame, asked: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", scale: float = 256.0, pivots: int = 32, sample: int = SAMPLE, segment: int = SEGMENT) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` that ``asked`` marks, the ``k`` others of the highest integer inner product, equal scores by id.

    A component x counts as floor(scale * x). Rows without an integer id, with a null vector or one
    that holds null, NaN or infinity take no part. Shorter vectors count as filled up with zeros;
    an empty one scores 0. Every row is a candidate and, if marked, a query of its own, repeated
    ones too; a row is no candidate of a query with its own id. Scores are exact as long as they
    fit 64 bits. Pivots are chosen from about ``sample`` rows: they change the work, not the
    result. Other columns are not looked at. An empty table gives an empty result.
    """
    whole = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col(key).isNotNull() & whole).select(F.col(key).cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), v.alias("v"))
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    some = rows.where(draw_of(F.lit(12), "vec_id", "v") < share(n, sample)).select("vec_id", "v").sort("vec_id", "v").limit(4 * sample).collect() if n else []
    pivot = choose(np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in some], np.int64).reshape(len(some), width), pivots)
    if not len(pivot):
        pivot = np.zeros((1, width), np.int64)

    def measure(batches):
        for b in batches:
            norm, angle = angles(matrix(b.column("v"), width), pivot)
            flat = pa.array(angle.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(angle) + 1) * len(pivot), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle.argmin(axis=1), pa.int32()), pa.array(norm), lists], [*b.schema.names, "near", "norm", "angles"])

    kinds = "vec_id long, asked boolean, v array<long>, near int, norm double, angles array<double>"
    table = written(in_arrow(rows, measure, kinds).withColumn("row", F.monotonically_increasing_id()))
    # a pivot's rows make as many segments as their number asks for; no segment has far more rows than the mean
    room = max(1, min(segment // (8 * (width + len(pivot) + 4)), max(LEAST_ROWS, n // EVEN)))
    many = {r["near"]: -(-r["count"] // room) for r in table.groupBy("near").count().collect()}
    splits = F.element_at(F.array(*[F.lit(many.get(p, 1)).cast("long") for p in range(len(pivot))]), F.col("near") + 1)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in np.cumsum([0, *(many.get(p, 0) for p in range(len(pivot)))])[:-1].tolist()]), F.col("near") + 1)
    n_segments = sum(many.values())
    dealt = written(table.withColumn("seg", base + F.pmod(F.xxhash64("row"), splits)).drop("near").repartition("seg").sortWithinPartitions("seg"))

    def at_home(batches):
        """Queries with their k-th best score among the rows of their segment that this task has."""
        for b in _segments(batches):
            ids, x, norms, angle = _columns(b, width)
            own = Segment(ids, x, norms, angle)
            q = np.flatnonzero(b.column("asked").to_numpy(zero_copy_only=False))
            got = [own.best(k, int(ids[i]), x[i], float(norms[i]), angle[i], NO_SCORE)[0] for i in q]
            least = [int(s[-1]) if len(s) == k else NO_SCORE for s in got]
            yield pa.RecordBatch.from_arrays([*(b.take(pa.array(q)).column(c) for c in ("vec_id", "v", "norm", "angles", "row")), pa.array(least, pa.int64())], ["vec_id", "v", "norm", "angles", "row", "least"])

    home = written(in_arrow(dealt, at_home, "vec_id long, v array<long>, norm double, angles array<double>, row long, least long"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n_segments - 1)).cast("long")))
    queries = home.select(everywhere.alias("seg"), "vec_id", "v", "norm", "angles", "row", "least")
    both = dealt.select("seg", "vec_id", "v", "norm", "angles", "row", F.lit(None).cast("long").alias("least")).unionByName(queries)

    def search(batches):
        seg, held, own = None, [], None
        for b in batches:
            number, asks = b.column("seg").to_numpy(), b.column("least").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((np.diff(number) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1, len(number)].tolist() if len(number) else []
            for lo, hi in zip(cuts, cuts[1:]):
                part = b.slice(lo, hi - lo)
                if number[lo] != seg:
                    seg, held, own = number[lo], [], None
                if not asks[lo]:
                    held.append(part)
                    continue
                if own is None:
                    own = Segment(*_columns(pa.concat_batches(held), width)) if held else None
                    held = []
                if own is None:
                    continue
                ids, x, norms, angle = _columns(part, width)
                least, row = part.column("least").to_numpy(), part.column("row").to_numpy()
                got = [own.best(k, int(ids[i]), x[i], float(norms[i]), angle[i], int(least[i])) for i in range(len(ids))]
                size = [len(s) for s, _ in got]
                if sum(size):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row, size)), pa.array(np.repeat(ids, size)), pa.array(np.concatenate([d for _, d in got])), pa.array(np.concatenate([s for s, _ in got]))], ["row", "query_id", "vec_id", "score"])

    met = both.repartition("seg").sortWithinPartitions("seg", F.col("least").isNotNull())
    found = in_arrow(met, search, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = (
    "with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), "
    "s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0) "
    "select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5"
)
