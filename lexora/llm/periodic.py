"""Periodic runs: stretches of a text that repeat a few words over and over.

The words of a batch of texts become one array of numbers that are of their text alone, so one
suffix array serves all its texts. The method: the array of longest previous factors, from suffix
array and LCP; the blocks of the Lempel-Ziv parse that it gives; at every block's edge Main's
extensions, left and right, of every period that the two blocks beside it allow; and the runs
inside of a block, which are copies of earlier ones, taken from buckets by start.

Let a block begin at s and the one before it at r. A run that ends inside of the block and begins
at s or before begins after r - p, p its period, since otherwise all from r to the run's end would
stand p words earlier too and the block at r would be longer. So p (exponent - 1) is less than both
blocks' length, and a text's edges try less than 2n / (exponent - 1) periods in all. A word of a
run of exponent x occurs x times in its text: rarer ones are left out beforehand and part the rest.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, in_arrow, pieces, word_parts

#: Bytes of texts that share a suffix array. A longer text has one of its own.
TOGETHER = 1 << 21
RUN = "struct<start:long,length:long,period:long>"


def suffixes(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the suffix array of s, levels): level k tells places apart by their first 2**k symbols, as long as any two are alike; past the end it is -1.

    By doubling; only suffixes that are not yet alone are sorted again.
    """
    n = len(s)
    sa = np.argsort(s, kind="stable")
    new = np.r_[True, s[sa[1:]] != s[sa[:-1]]][:n]
    at, i, levels, h = np.arange(n), sa, [], 1
    rank = np.full(n + 1, -1, np.int64)
    while len(at):
        rank = rank.copy()
        rank[i] = np.maximum.accumulate(np.where(new, at, 0))
        at = at[~(new & np.r_[new[1:], True])]
        if not len(at):
            break
        levels.append(rank)
        i = sa[at]
        key = rank[i] * (n + 1) + rank[np.minimum(i + h, n)] + 1
        order = np.argsort(key, kind="stable")
        i, key = i[order], key[order]
        sa[at] = i
        new = np.r_[True, key[1:] != key[:-1]]
        h *= 2
    return sa, levels


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from the places i and j on, or, backward, up to and with them. No i equals its j."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        h, rank = 1 << k, levels[k]
        if back:
            a, b = i - got - (h - 1), j - got - (h - 1)
            same = (np.minimum(a, b) >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
        else:
            end = len(rank) - 1
            same = rank[np.minimum(i + got, end)] == rank[np.minimum(j + got, end)]
        got += h * same
    return got


def _smaller_before(pos: np.ndarray, lcp: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, place): of each suffix in the suffix array's order the nearest one before it that begins earlier in the text, and their common prefix.

    Windows of doubled width skip what begins later; none goes further than the suffixes that share a first symbol.
    """
    n = len(pos)
    low, edge = [pos], [lcp]
    while 1 << len(low) < widest:
        h, a, b = 1 << (len(low) - 1), low[-1], edge[-1]
        low.append(np.minimum(a, np.r_[np.full(min(h, n), -1), a[:-h]]))
        edge.append(np.minimum(b, np.r_[np.zeros(min(h, n), np.int64), b[:-h]]))
    at, reach = np.arange(n) - 1, lcp.copy()
    for k in range(len(low) - 1, -1, -1):
        skip = (reach > 0) & (low[k][at] > pos)
        reach = np.where(skip, np.minimum(reach, edge[k][at]), reach)
        at = at - (skip << k)
    found = (reach > 0) & (pos[at] < pos)
    return np.where(found, reach, 0), np.where(found, pos[at], -1)


def longest_previous(s: np.ndarray, sa: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, source): of each place the length of the longest factor that also begins at an earlier place, and that place."""
    n = len(s)
    lpf, source = np.zeros(n, np.int64), np.full(n, -1)
    if levels:
        lcp = np.r_[0, common(levels, sa[:-1], sa[1:])]
        widest = int(np.diff(np.flatnonzero(np.r_[True, lcp[1:] == 0, True])).max())
        left = _smaller_before(sa, lcp, widest)
        right = [x[::-1] for x in _smaller_before(sa[::-1], np.r_[0, lcp[:0:-1]], widest)]
        better = right[0] > left[0]
        lpf[sa], source[sa] = (np.where(better, r, x) for r, x in zip(right, left))
    return lpf, source


def edge_runs(s: np.ndarray, levels: list[np.ndarray], cuts: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs that touch an edge of two blocks, by Main's extensions. ``cuts``: where blocks begin, and the end."""
    n = len(s)
    edge, around = cuts[1:], (cuts[1:] - cuts[:-1]) + np.r_[np.diff(cuts)[1:], 0]
    many = (around - 1) // (exponent - 1)
    b = np.repeat(edge, many)
    p = np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many) + 1
    symbol = np.append(s, -1)
    found = []
    # the period stands left of the edge, or right of it
    for i, j, fits in ((b - p, b, p <= b), (b, b + p, b + p <= n)):
        i, j, q = i[fits], j[fits], p[fits]
        alike = (symbol[i] == symbol[j]) | ((i > 0) & (s[i - 1] == s[j - 1]))
        i, j, q = i[alike], j[alike], q[alike]
        ahead, behind = common(levels, i, j), common(levels, i - 1, j - 1, back=True)
        length = ahead + behind + q
        fits = length >= np.maximum(least, exponent * q)
        found.append(np.stack([i - behind, i - behind + length, q])[:, fits])
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # of the periods of one stretch the smallest: the others are its multiples
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    return list(zip(start[first].tolist(), end[first].tolist(), period[first].tolist()))


def all_runs(s: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of s that are of ``least`` symbols and ``exponent`` (2 or more) periods at least, in order of their starts."""
    sa, levels = suffixes(s)
    lpf, source = longest_previous(s, sa, levels)
    step, cuts, i = lpf.tolist(), [], 0
    while i < len(step):
        cuts.append(i)
        i += step[i] or 1
    cuts = np.array([*cuts, len(step)])
    found = edge_runs(s, levels, cuts, least, exponent) if levels else []
    if not found:
        return []
    # runs inside of a block are copies of runs inside of its source
    ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, e, p in found:
        ends[a].append((e, p))
    starts = sorted(ends)
    wide = np.flatnonzero(np.diff(cuts) >= max(least, exponent) + 2)
    for lo, size in zip(cuts[wide].tolist(), np.diff(cuts)[wide].tolist()):
        src = int(source[lo])
        k = bisect_right(starts, src)
        while k < len(starts) and starts[k] < src + size:
            a = starts[k]
            for e, p in ends[a]:
                if e < src + size:
                    to = a - src + lo
                    if to not in ends:
                        insort(starts, to)
                    ends[to].append((e - src + lo, p))
            k += 1
    return [(a, e, p) for a in starts for e, p in ends[a]]


def piece_runs(starts: np.ndarray, parts: pa.Array, least: int, exponent: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(each word's row, (start, end, period) of all runs of a piece's texts, by word number within the piece). No part is empty."""
    n = np.diff(starts)
    row = np.repeat(np.arange(len(n)), n)
    words = parts.dictionary_encode()
    key = row * max(1, len(words.dictionary)) + words.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]][: len(key)]
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(group) else group
    s = np.empty(len(key), np.int64)
    s[order] = np.where(size[group] >= exponent, group, -1)
    # stretches without rare words, each followed by a number of its own
    keep = s >= 0
    last = keep & ~np.r_[keep[1:], False]
    ends_row = np.r_[row[1:] != row[:-1], True][: len(row)]
    part = last | (keep & ends_row)
    place = np.flatnonzero(keep)
    gaps = np.cumsum(part[place]) - part[place]
    text = np.empty(len(place) + int(part.sum()), np.int64)
    back = np.full(len(text), -1)
    at = np.arange(len(place)) + gaps
    text[at], back[at] = s[place], place
    text[back < 0] = len(size) + np.arange(int((back < 0).sum()))
    runs = [(int(back[a]), int(back[a]) + e - a, p) for a, e, p in all_runs(text, least, exponent)]
    return row, sorted(runs)


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4, key: str = "doc_id") -> DataFrame:
    """key, n_words, runs and collapsed of each row of ``docs(key, text)``.

    runs has (start, length, period) of every maximal stretch of words with smallest period q that
    has ``least`` words and ``exponent`` * q at least, by start, then period; collapsed has the words
    that no run holds after its first q, joined by one space. A null text has no words, as one of
    blanks. Rows are on their own: repeated ones have equal results, a null key stays null, other
    columns are not looked at. An empty table gives an empty result.
    """

    def run(batches):
        for b in pieces(batches, TOGETHER):
            offsets, parts = word_parts(b, lower=False)
            full = pc.not_equal(parts, "").to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(full)][offsets - offsets[0]]
            parts = parts.filter(pa.array(full))
            row, runs = piece_runs(starts, parts, least, exponent)
            drop = np.zeros(len(parts) + 1, np.int64)
            a, e, p = np.array(runs, np.int64).reshape(-1, 3).T
            np.add.at(drop, a + p, 1)
            np.add.at(drop, e, -1)
            kept = np.cumsum(drop[:-1]) == 0
            left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][starts], pa.int32()), parts.filter(pa.array(kept)))
            of = row[a]
            fields = [pa.array(x, pa.int64()) for x in (a - starts[of], e - a, p)]
            each = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(b.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(starts), pa.int64()), each, pc.binary_join(left, " ")], [key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return in_arrow(docs.select(key, "text"), run, f"`{key}` {kind}, n_words long, runs array<{RUN}>, collapsed string")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the ids, by hash, the text from some word on repeats its first words. A null id's text stays.

    With h = crc32(id), g = h div 10 and n words: if 10 divides h, each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # exploded, so that it is computed once a row
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.explode(F.array(F.coalesce(words, F.array().cast("array<string>")))).alias("w"))
    n = F.size("w")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    put = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(F.col("w"), F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(put, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (of equals the first, then that of the smallest period), and digests of all runs and of the words left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(F.col("b.length") * 1000 / -F.col("b.period"))
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), (-F.col("b.period")).alias("period"), exponent.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
