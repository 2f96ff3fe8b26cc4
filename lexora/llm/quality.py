"""Quality rules: an isolation forest over rule statistics, with its threshold calibrated on labelled rows.

Statistics are taken of every whole text. The forest is fitted on documents labelled good that
pass the base rules, its random splits drawn over each statistic's fixed range: what lies where
no good document lies is cut off after few splits, however many documents lie there (a forest
fitted on all documents hides a common kind of junk from itself). It sees about ``fit_rows`` of
them at most, from one half of the labelled ids. Every labelled row of the other half calibrates,
by a histogram of scores: the threshold is the one that rejects most low-quality rows while it
rejects at most ``max_loss`` of the good ones. All documents are scored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import draw_of, in_arrow, saved, share, texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower()
DIGITS = b"0123456789"
SPAN = 50
#: Steps of the scores' histogram.
STEPS = 1 << 14
#: The forest sees these shares of the statistics, clipped to these ranges. Distinct words are counted by SPAN words, so that a long text's share is not lower.
FEATURES = {"word_len": 12.0, "symbols": 3.0, "upper": 1.0, "marks": 2.0, "dup_lines": 1.0, "repeat_words": 1.0, "digits": 1.0, "distinct": 1.0}


def _windows(ids: np.ndarray) -> np.ndarray:
    """A number for each window of WINDOW words: equal exactly if the windows are equal. By doubling of ranks."""
    rank, at = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while at < WINDOW:
        pair = rank[:-at] * (int(rank.max()) + 1) + rank[at:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        at *= 2
    return rank


def repeat_words(w: list[bytes]) -> int:
    """Words that lie in 8-word windows found twice or more in the text, first occurrences included."""
    n = len(w) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    roll = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):  # equal windows have equal sums, so no duplicate sum means no repeat
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    if len(np.unique(roll)) == n:
        return 0
    seen: dict[bytes, int] = {}
    rank = _windows(np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w)))
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters, n_marks, n_digits, n_distinct, n_span_distinct)."""
    t = text or ""
    b = t.encode("utf-8", "surrogatepass")
    w = b.split()
    lines = Counter(x for x in b.split(b"\n") if x.strip())
    n_lines = sum(lines.values())
    gone = lambda kinds: len(b) - len(b.translate(None, kinds))
    return (
        len(w),
        len(t) - sum(map(t.count, BLANKS)),
        sum(map(t.count, SYMBOLS)),
        n_lines - len(lines),
        repeat_words(w),
        n_lines,
        gone(UPPER),
        gone(LETTERS),
        b.count(b"!") + b.count(b"?"),
        gone(DIGITS),
        len(set(w)),
        sum(len(set(w[i : i + SPAN])) for i in range(0, len(w), SPAN)),
    )


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct", "n_span_distinct"]


def features(stats: np.ndarray) -> np.ndarray:
    """(n, len(FEATURES)) of (n, len(STATS)) counts; shares that do not depend on a text's length."""
    s = stats.astype(np.float64)
    w = np.maximum(s[:, 0], 1)
    shares = [s[:, 1] / w, s[:, 2] / w, s[:, 6] / np.maximum(s[:, 7], 1), s[:, 8] / w, s[:, 3] / np.maximum(s[:, 5], 1), s[:, 4] / w, s[:, 9] / np.maximum(s[:, 1], 1), s[:, 11] / w]
    x = np.stack(shares, axis=1)
    return np.clip(x, 0.0, list(FEATURES.values()))


def _c(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random axis splits of small samples; score 2 ** (-mean path / c(sample)), higher for anomalies.

    A split cuts the node's box (``high`` bounds the root's, from 0) and not the spread of its
    points, so a statistic that is constant in the sample still isolates what differs from it.
    """

    def __init__(self, trees: int = 200, sample: int = 256, depth: int = 12, seed: int = 11):
        self.trees, self.sample, self.depth, self.seed = trees, sample, depth, seed

    def fit(self, x: np.ndarray, high: list[float]) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        self.used = min(self.sample, len(x))
        nodes: list[list] = []
        self.roots = []
        for _ in range(self.trees):
            rows = rng.choice(len(x), self.used, replace=False)
            self.roots.append(len(nodes))
            todo = [(len(nodes), rows, 0, np.zeros(len(high)), np.array(high, float))]
            nodes.append([-1, 0.0, 0, 0, 0.0])
            while todo:
                at, r, d, lo, hi = todo.pop()
                if len(r) <= 1 or d >= self.depth:
                    nodes[at][4] = d + float(_c(len(r)))
                    continue
                f = int(rng.integers(len(high)))
                cut = float(rng.uniform(lo[f], hi[f]))
                low = x[r, f] < cut
                nodes[at][:4] = [f, cut, len(nodes), len(nodes) + 1]
                below, above = hi.copy(), lo.copy()
                below[f] = above[f] = cut
                todo += [(len(nodes), r[low], d + 1, lo, below), (len(nodes) + 1, r[~low], d + 1, above, hi)]
                nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
        a = np.array(nodes, float).reshape(-1, 5)
        self.feature, self.cut = a[:, 0].astype(np.int64), a[:, 1]
        self.low, self.high, self.path = a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] < self.cut[at], self.low[at], self.high[at]))
            total += self.path[at]
        return 2.0 ** (-total / max(1, len(self.roots)) / max(float(_c(self.used)), 1e-9))


def calibrate(hist: list[tuple[int, bool, int]], max_loss: float) -> float:
    """The threshold at or above which a document is rejected, of ``hist(step, good, n)``: most low-quality rows caught, at most max_loss of the good."""
    n_good, n_bad = (sum(n for _, g, n in hist if g is side) for side in (True, False))
    if not n_good or not n_bad:
        return math.inf
    best, lost, caught, above = None, 0, 0, None
    steps = sorted({s for s, _, _ in hist}, reverse=True)
    count = {(s, g): n for s, g, n in hist}
    for at, s in enumerate(steps):  # from the most anomalous down
        lost += count.get((s, True), 0)
        caught += count.get((s, False), 0)
        if lost > max_loss * n_good:
            break
        gain = caught / n_bad - lost / n_good
        if caught and (best is None or gain > best):
            best, above = gain, (s, steps[at + 1] + 1 if at + 1 < len(steps) else s)
    return math.inf if above is None else sum(above) / 2 / STEPS


def _stats(batches):
    for b in batches:
        rows = list(zip(*map(statistics, texts(b)))) or [()] * len(STATS)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)] + [pa.array(c, pa.int64()) for c in rows], ["doc_id", "text_hash", *STATS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the counts in STATS of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return in_arrow(src, _stats, f"doc_id {kind}, text_hash long, " + ", ".join(f"{c} long" for c in STATS))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = 50_000, max_loss: float = 0.001) -> tuple[IsolationForest | None, float]:
    """Forest and threshold of labelled rows that pass the base rules; a text that is low in one label is low.

    Half of the ids, by hash, are for the forest, which takes about ``fit_rows`` distinct good texts
    of them on the driver; the other half calibrates, whole and distributed.
    """
    lab = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = saved(stats.where(~F.col("base_failed")).join(lab, "doc_id").select("doc_id", "text_hash", (F.col("quality") > 0).alias("good"), (F.pmod(draw_of(F.lit(12), "doc_id"), F.lit(2)) == 0).alias("fits"), *STATS))
    some = rows.where("good AND fits").dropDuplicates(["doc_id", "text_hash"])
    draw = draw_of(F.lit(6), "doc_id", "text_hash")
    some = some.where(draw < share(some.count(), fit_rows)).withColumn("draw", draw).select("draw", "doc_id", *STATS).collect()
    if len(some) < 2:
        return None, math.inf
    forest = IsolationForest().fit(features(np.array([r[2:] for r in sorted(some)], np.int64)), list(FEATURES.values()))

    def run(batches):
        for b in batches:
            x = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((forest.score(features(x)) * STEPS).astype(np.int32))], ["good", "step"])

    scored = in_arrow(rows.where(~F.col("fits")).select("good", *STATS), run, "good boolean, step int")
    return forest, calibrate([tuple(r) for r in scored.groupBy("step", "good").count().collect()], max_loss)


def judge(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, the counts in STATS, base_failed, anomaly and kept.

    ``labels(doc_id, quality)`` calibrates; rows without a label or id are judged like any other.
    A null or empty text has no words and fails the base rules. Without labels of both kinds only
    the base rules reject. Repeated rows are judged alike; an empty table gives an empty result.
    """
    stats = saved(rule_statistics(docs).withColumn("base_failed", base_failed()))
    forest, threshold = fit(stats, labels, **bounds)
    names = ["doc_id", "text_hash", *STATS, "base_failed"]

    def run(batches):
        for b in batches:
            s = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(STATS))], axis=1)
            score = forest.score(features(s)) if forest else np.zeros(len(s))
            failed = b.column(len(names) - 1).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(score), pa.array(~failed & (score < threshold))], [*names, "anomaly", "kept"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return in_arrow(stats.select(*names), run, f"{schema}, anomaly double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with its columns. Equal rows are kept or rejected together.

    A null or empty text is rejected; a null id is judged like any other. An empty table stays empty.
    The statistics are taken twice, for the fit and for the verdict, so that no text is shuffled.
    """
    stats = saved(rule_statistics(docs).withColumn("base_failed", base_failed()))
    forest, threshold = fit(stats, labels, **bounds)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = np.array([statistics(t) for t in b.column(at).to_pylist()], np.int64).reshape(-1, len(STATS))
            ok = (s[:, 0] >= MIN_WORDS) & (100 * s[:, 4] <= REPEAT_PERCENT * s[:, 0])
            if forest:
                ok &= forest.score(features(s)) < threshold
            yield b.filter(pa.array(ok))

    return in_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
