"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

Words are hashed into three embedding tables, by the whole word and by its first letters, so that a
form never seen shares what its relatives taught. Filters of several widths run over the whole
text, and each keeps its highest value (max pooling). The net is trained on a bounded number of
labelled rows (about ``toxic_rows`` and ``clean_rows``, the first by hashed id) and of their words
(``most_words``). All texts are
scored whole. Every labelled row that is neither held out nor trained on (a fifth at least)
calibrates, by histograms of scores: scores are shifted so that the best F1 lies at ``at_score``,
and each language gets its own best threshold beside it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, draw_of, in_arrow, lower_words, saved, share, texts, written

BITS = 16
BUCKETS = 1 << BITS
DIM = 8  # of each table
#: A table for each: by the whole word, and by its first letters, so that forms of a word share what is learned.
PREFIXES = (None, 4, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
MARKS = b"\"'`.,;:()[]{}<>#*$%&|!?=-_"
CHUNK = 1 << 16
#: What stands for a text without words: a word of no meaning.
NO_WORDS = np.zeros(1, np.int64)
#: Steps of a histogram to a unit of the logit.
STEPS = 64


class Hashed(dict):
    """Words' buckets, BITS each, as one number, remembered up to a bound: of the whole word and of its first letters."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        core = w.strip(MARKS) or w
        letters = core.decode("utf-8", "replace")
        out = 0
        for k, n in enumerate(PREFIXES):
            part = core if n is None else letters[:n].encode()
            out |= (xxhash.xxh64_intdigest(part, 9 + k) & (BUCKETS - 1)) << (BITS * k)
        self[w] = out
        return out


def buckets(text: str, known: Hashed) -> np.ndarray:
    w = lower_words(text)
    return np.fromiter(map(known.__getitem__, w), np.int64, len(w))


def bucket(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th table's bucket of each hashed word."""
    return (h >> (BITS * k)) & (BUCKETS - 1)


class Net:
    """logit = out . max over places of relu(filter . words) + bias."""

    def __init__(self, seed: int = 23):
        rng = np.random.default_rng(seed)
        d, k = len(PREFIXES) * DIM, len(WIDTHS) * FILTERS
        self.tables = [rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32) for _ in PREFIXES]
        self.filters = [rng.normal(0, 1 / math.sqrt(d * w), (w, d, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.level = np.zeros(k, np.float32)
        self.out = rng.normal(0, 0.3, k).astype(np.float32)
        self.bias = np.float32(0)

    def embed(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([t[bucket(h, k)] for k, t in enumerate(self.tables)], axis=1)

    def rows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(embedded words of all texts, hashed words or -1, first row of each text): texts lie behind one another, with rows of zeros between."""
        gap = np.full(WIDTHS[-1] - 1, -1, np.int64)
        parts = [gap]
        for h in texts:
            parts += [h, gap]
        words = np.concatenate(parts)
        first = np.cumsum([len(gap)] + [len(h) + len(gap) for h in texts])[:-1]
        x = self.embed(np.maximum(words, 0))
        x[words < 0] = 0
        return x, words, first

    def pool(self, x: np.ndarray, first: np.ndarray, n: np.ndarray, begins: bool = True, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(texts, filters): each filter's highest value over a text's places, and the first row it was found from.

        A window may reach into the zeros beside its text where that begins or ends, not where it is cut.
        """
        best, place = [], []
        for w, f in zip(WIDTHS, self.filters):
            m = len(x) - w + 1
            y = x[:m] @ f[0]
            for j in range(1, w):
                y += x[j : j + m] @ f[j]
            size = np.maximum(n - (w - 1) + (w - 1) * (int(begins) + int(ends)), 1)
            start = np.cumsum(size) - size
            at = np.arange(size.sum()) + np.repeat(first - (w - 1) * int(begins) - start, size)
            y = y[at]
            top = np.maximum.reduceat(y, start)
            best.append(top)
            place.append(np.minimum.reduceat(np.where(y == np.repeat(top, size, axis=0), at[:, None], len(x)), start))
        return np.concatenate(best, axis=1), np.concatenate(place, axis=1)

    def logit(self, h: np.ndarray) -> float:
        """Of one text's hashed words, by themselves, so that it does not depend on what is scored beside it; a long text goes in chunks that overlap by the widest filter."""
        h = h if len(h) else NO_WORDS
        top = np.full(len(self.out), -np.inf, np.float32)
        for at in range(0, len(h), CHUNK):
            s, e = max(0, at - WIDTHS[-1]), min(len(h), at + CHUNK + WIDTHS[-1])
            x, _, first = self.rows([h[s:e]])
            top = np.maximum(top, self.pool(x, first, np.array([e - s]), s == 0, e == len(h))[0][0])
        return float(np.maximum(top + self.level, 0) @ self.out + self.bias)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 16, batch: int = 32, rate: float = 0.02, seed: int = 29) -> Net:
        """Adam for filters and output, Adagrad for the embeddings that a batch touches."""
        rng = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
        params = [*self.filters, self.level, self.out]
        m = [np.zeros_like(p) for p in params]
        v = [np.zeros_like(p) for p in params]
        seen = [np.full(BUCKETS, 1e-4, np.float32) for _ in PREFIXES]
        k = 0
        rows = [h if len(h) else NO_WORDS for h in rows]
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), batch):
                some = order[s : s + batch]
                own = [rows[i] for i in some]
                x, words, first = self.rows(own)
                top, place = self.pool(x, first, np.array([len(h) for h in own]))
                act = np.maximum(top + self.level, 0)
                z = np.clip(act @ self.out + self.bias, -30, 30)
                d = ((1 / (1 + np.exp(-z)) - y[some]) * weight[some] / len(some)).astype(np.float32)
                up = d[:, None] * self.out * (act > 0)
                grads, touched = [], []
                for c, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                    u, at = up[:, c * FILTERS : (c + 1) * FILTERS], place[:, c * FILTERS : (c + 1) * FILTERS]
                    g = np.empty_like(f)
                    for j in range(w):
                        g[j] = np.einsum("bfd,bf->df", x[at + j], u)
                        real = (words[at + j] >= 0) & (u != 0)
                        touched.append((words[at + j][real], (f[j].T[None] * u[..., None])[real]))
                    grads.append(g)
                grads += [up.sum(axis=0), d @ act]
                k += 1
                step = rate * 0.5 * (1 + math.cos(math.pi * k / (epochs * (len(order) / batch + 1))))
                for p, g, a, b in zip(params, grads, m, v):
                    g = g + 1e-3 * p
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    p -= step * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-7)
                self.bias -= np.float32(step * d.sum())
                h, g = (np.concatenate(t) for t in zip(*touched))
                for c, (table, sums) in enumerate(zip(self.tables, seen)):
                    u, inv = np.unique(bucket(h, c), return_inverse=True)
                    total = np.zeros((len(u), DIM), np.float32)
                    np.add.at(total, inv, g[:, c * DIM : (c + 1) * DIM])
                    sums[u] += (total * total).mean(axis=1)
                    table[u] -= 0.1 * total / np.sqrt(sums[u])[:, None]
        for p in params:  # weights that decay took towards zero are slow (denormal) numbers
            p[np.abs(p) < 1e-8] = 0
        return self


def best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The logit at or above which weighted F1 is best, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    tp, all_ = np.cumsum(w * (y > 0)), np.cumsum(w)
    f1 = 2 * tp / (all_ + (w * (y > 0)).sum())
    last = np.r_[z[1:] < z[:-1], True]
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k])


def labelled(labels: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id and toxic (0 or 1) of labelled rows whose id is not held out (crc32 of the id modulo ``folds``); a row that is toxic once is toxic."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out))
    return lab.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def in_sample(toxic: int, clean: int, toxic_rows: int, clean_rows: int) -> Column:
    """Whether the net trains on a labelled row: four of five rows may, and of ``toxic`` and ``clean`` rows about so many do."""
    of = lambda n, rows: share(n * 4 // 5, rows)
    return (F.pmod(draw_of(F.lit(5), "doc_id"), F.lit(5)) != 0) & (draw_of(F.lit(8), "doc_id") < F.when(F.col("toxic") > 0, of(toxic, toxic_rows)).otherwise(of(clean, clean_rows)))


def hashed_rows(docs: DataFrame, some: DataFrame) -> DataFrame:
    """draw, doc_id, toxic, n and words (little-endian hashes, 8 bytes each) of the documents of ``some(doc_id, toxic)``, a written table; of rows that share an id, the text of the least hash."""
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.select(draw_of(F.lit(8), "doc_id").alias("draw"), "doc_id", "toxic", "text")

    def run(batches):
        known = Hashed()
        for b in batches:
            h = [buckets(t, known) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([len(x) for x in h], pa.int64()), pa.array([x.astype("<i8").tobytes() for x in h], pa.binary())], ["draw", "doc_id", "toxic", "n", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(in_arrow(rows, run, f"draw long, doc_id {kind}, toxic int, n long, words binary"))


def train(docs: DataFrame, some: DataFrame, most_words: int) -> Net | None:
    """The net of the documents of ``some(doc_id, toxic)``, a bounded number. None without five of either kind.

    The driver gets words' hashes, no texts, and ``most_words`` of them at most: in an order by
    hash, a document that would go beyond is left out, whole.
    """
    rows = hashed_rows(docs, some)
    sizes = rows.select(draw_of(F.lit(13), "doc_id").alias("turn"), "doc_id", "n").collect()  # a bounded number
    fits, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["turn"], r["doc_id"])):
        if total + r["n"] <= most_words:
            total += r["n"]
            fits.append(r["doc_id"])
    whole = len(fits) == len(sizes)
    got = (rows if whole else rows.where(F.col("doc_id").isin(fits))).collect()
    got = sorted(((r["draw"], r["doc_id"], r["words"], r["toxic"]) for r in got), key=lambda r: r[:2])
    y = np.array([r[3] for r in got], int)
    if y.sum() < 5 or (1 - y).sum() < 5:
        return None
    return Net().fit([np.frombuffer(h, "<i8").astype(np.int64) for _, _, h, _ in got], y)


def cuts(hist: list[tuple[str, int, int, int]], all_toxic: int, all_clean: int, least: tuple[int, int] = (50, 10)) -> tuple[float | None, dict[str, float]]:
    """The best logit to cut at over all rows of ``hist(lang, toxic, step, n)``, and over each language with so many rows and toxic rows."""
    if not hist:
        return None, {}
    lang, y, z, n = (np.array(c) for c in zip(*hist))
    got = [max(1, int(n[y == t].sum())) for t in (0, 1)]
    w = n * np.where(y > 0, all_toxic / got[1], all_clean / got[0])
    z = (z + 0.5) / STEPS
    if not (y > 0).any():
        return float(z.max() + 1), {}
    own = {}
    for name in sorted(set(lang.tolist())):
        at = lang == name
        if n[at].sum() >= least[0] and n[at & (y > 0)].sum() >= least[1]:
            own[name] = best_cut(z[at], y[at], w[at])
    return best_cut(z, y, w), own


def score_toxicity(docs: DataFrame, labels: DataFrame, at_score: float = 0.3, toxic_rows: int = 2500, clean_rows: int = 4000, held_out: int = 2, folds: int = 4, most_words: int = 1 << 23) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, lang_threshold, flagged.

    score sees the text alone. predicted is score >= ``at_score``; flagged compares with the
    language's threshold (``at_score`` for a language without enough labels, and for a null).
    A null or empty text is scored as one without words. Without enough labels every score is
    0.01. Repeated rows give repeated rows; an empty table gives an empty result. Labels are joined
    with scores, never with texts, but for the training sample, of which the driver gets no text
    and ``most_words`` hashed words at most.
    """
    lab = saved(labelled(labels, held_out, folds))
    toxic, clean = (x or 0 for x in lab.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    chosen = in_sample(toxic, clean, toxic_rows, clean_rows)
    net = train(docs, lab.where(chosen), most_words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", "text", "lang", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"))

    def run(batches):
        known = Hashed()
        for b in batches:
            z = np.array([net.logit(buckets(t, known)) if net else math.log(0.01 / 0.99) for t in texts(b)], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(2), pa.array(z)], ["doc_id", "held_out", "lang", "logit"])

    raw = saved(in_arrow(src, run, f"doc_id {kind}, held_out boolean, lang string, logit double"))
    shift, own = 0.0, {}
    if net:
        step = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit"))) * STEPS).cast("int")
        hist = raw.join(lab.where(~chosen), "doc_id").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", step.alias("step")).count()
        cut, own = cuts([tuple(r) for r in hist.collect()], toxic, clean)
        shift = 0.0 if cut is None else math.log(at_score / (1 - at_score)) - cut
    by_lang = docs.sparkSession.createDataFrame([(k, 1 / (1 + math.exp(-(v + shift)))) for k, v in own.items()], "name string, own double")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("logit") + shift))))
    out = raw.join(F.broadcast(by_lang), F.coalesce("lang", F.lit("")) == F.col("name"), "left").withColumn("score", score)  # a row for each language with enough labels
    out = out.withColumn("lang_threshold", F.coalesce("own", F.lit(at_score)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= at_score).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
