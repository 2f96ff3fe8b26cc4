"""Joins of a large side with a small one, and with a vocabulary that may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 50_000
#: Code points up to which a term may travel in a broadcast: with BROADCAST_ROWS this bounds its bytes.
BROADCAST_CHARS = 200


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows it has at most ``limit`` rows; beyond that joins shuffle it, and Spark splits skewed keys."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_terms(rows: DataFrame, vocab: DataFrame, keys: list[str], weight: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` inner-joined with a vocabulary (unique ``keys``) on keys of any skew; ``weight`` is dropped.

    The vocabulary's heaviest rows, at most ``limit``, are broadcast: they hold nearly all of the
    rows, and every hot key. Only rows of lighter keys are shuffled to meet the rest. A vocabulary
    that fits is broadcast whole. Both sides are read more than once, so they should be written
    tables. The heaviest are told apart by a histogram of weights, not by a sort.
    """
    heavy, light = split_terms(rows, vocab, keys, weight, limit)
    return heavy if light is None else light if heavy is None else heavy.unionByName(light)


def split_terms(rows: DataFrame, vocab: DataFrame, keys: list[str], weight: str, limit: int = BROADCAST_ROWS) -> tuple[DataFrame | None, DataFrame | None]:
    """join_terms() in two: what meets the heaviest rows where it lies, and what is shuffled to meet the rest. Either may be missing."""
    first = keys[0]
    step = F.floor(F.log2(F.greatest(F.col(weight), F.lit(1))) * 8).cast("int")
    carried = F.length(first) <= BROADCAST_CHARS
    counts = vocab.groupBy(F.when(carried, step).otherwise(-1).alias("s")).count().collect()  # a few hundred rows at most
    least, held = None, 0
    for s, n in sorted(counts, reverse=True):
        if s < 0 or held + n > limit:
            break
        least, held = s, held + n
    if held == sum(n for _, n in counts):
        return rows.join(F.broadcast(vocab.drop(weight)), keys), None
    if least is None:
        return None, rows.join(vocab.drop(weight), keys)
    heavy = carried & (step >= least)
    head, rest = vocab.where(heavy).drop(weight), vocab.where(~heavy).drop(weight)
    light = rows.join(F.broadcast(head.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(head), keys), light.join(rest, keys)
