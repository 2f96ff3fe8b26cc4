"""LM scoring: a gated recurrent language model in numpy with a class-factored output.

P(word | before) = P(class | before) P(word | class, before). The ``frequent`` commonest words lie
in classes of about equal weight; all other words lie in TAIL classes by their last letters,
inside of which a word's share is (c + 1) / (all its class's counts + its words + 1), so every
word has a probability and one of no count has the least. Counts are of all training documents
and so are the output's starting biases.

Texts are cut into words twice: for the counts, and, once these are known, into a table of model ids
that training and scoring read. The recurrent weights are trained by truncated backpropagation
through time on every training document, whole: they start from a fit on the driver of about
``fit_stretches`` stretches of ids (first by hash, cut from texts of any length), then ROUNDS rounds
take a disjoint share of the documents each. In a round every partition trains on its part, and
the weights are averaged, weighted by words.

Documents are scored whole: windows of WINDOW words, the state carried from one to the next. SIDE
documents of a batch run side by side, longest first, so none is padded. Counts of up to ``known``
of the commonest words travel with the code; a document's other words meet their counts in a join.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import crc_mod, draw_of, in_arrow, share, word_parts, written

TAIL = 32
WINDOW = 32
HIDDEN = 24
EMBED = 16
#: Bytes of text that are cut into words at a time.
PIECE = common.PIECE
ROUNDS = 3
RATE = 0.008
STREAMS = 256
#: Documents scored side by side, and states whose classes are told at a time: few enough for a core's cache.
SIDE = 1024
TILE = 4096
#: Ids of a stretch that the driver's start may learn from.
STRETCH = 2048
#: Ids that a partition gathers before it trains on them, and the parts in which weights are averaged.
BLOCK = 1 << 18
PARTS = 16


def tail_class(w: bytes) -> int:
    return zlib.crc32(w[-2:]) % TAIL


class Model:
    """The recurrent model over ids: 0 the end, 1..frequent-1 words by falling count, then the TAIL classes."""

    def __init__(self, counts: np.ndarray, tails: np.ndarray, classes: int = 32, seed: int = 31):
        """counts: of the frequent words by id; tails: of the TAIL classes' words."""
        rng = np.random.default_rng(seed)
        m = self.frequent = len(counts)
        root = np.sqrt(counts.astype(float) + 1)
        cls = np.minimum(np.floor((np.cumsum(root) - root) / root.sum() * classes).astype(np.int64), classes - 1)
        cls = np.unique(cls, return_inverse=True)[1]
        self.classes = int(cls.max()) + 1 if m else 0
        # a class is a run of ids, from bounds[c] to bounds[c + 1]; every tail class is one of its own
        self.bounds = np.searchsorted(cls, np.arange(self.classes + 1))
        self.cls = np.r_[cls, self.classes + np.arange(TAIL)].astype(np.int16)
        p = np.bincount(cls, counts, self.classes) + 1
        word_b = np.log(counts + 1.0)
        self.p = {
            "embed": rng.normal(0, 0.1, (m + TAIL, EMBED)),
            "in": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)),
            "in_b": np.r_[np.ones(HIDDEN), np.zeros(2 * HIDDEN)],
            "rec": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
            "cls": rng.normal(0, 0.01, (HIDDEN, self.classes + TAIL)),
            "cls_b": np.log(np.r_[p, tails + 1.0]) - np.log(max(p.max(initial=1), tails.max(initial=0) + 1)),
            "word": rng.normal(0, 0.01, (m, HIDDEN)),
            "word_b": word_b - np.concatenate([np.repeat(word_b[s:e].max(), e - s) for s, e in zip(self.bounds, self.bounds[1:])]) if m else word_b,
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, h: np.ndarray, rec_t: np.ndarray | None = None, out: tuple = (None, None, None)):
        """One step of the unit, a column a stream: x is the input's projection (3 HIDDEN, streams), h the states before; out may hold what it keeps."""
        u = np.matmul(self.p["rec"].T if rec_t is None else rec_t, h, out=out[0])
        zr = np.add(x[: 2 * HIDDEN], u[: 2 * HIDDEN], out=out[1])
        zr *= 0.5  # 1 / (1 + exp(-a)) is (1 + tanh(a / 2)) / 2
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = np.multiply(r, u[2 * HIDDEN :], out=out[2])
        n += x[2 * HIDDEN :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, u

    def steep(self) -> bool:
        """Whether a logit may be too large for exp() as it is: states lie in -1..1, so a column's weights bound its logits."""
        return any(float((np.abs(w).sum(axis=axis) + b).max(initial=0)) > 60 for w, b, axis in ((self.p["cls"], self.p["cls_b"], 0), (self.p["word"], self.p["word_b"], 1)))

    def _softmax(self, h: np.ndarray, w: np.ndarray, steep: bool, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(exp of the logits, their sums); h ends in a column of ones, w in the biases."""
        s = np.matmul(h, w, out=out)
        if steep:
            s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        return s, s @ np.ones(s.shape[1], s.dtype)

    def _weights(self) -> tuple[np.ndarray, np.ndarray]:
        """The classes' weights, a column a class, and the words', a row a word, each with its bias as the last."""
        return np.vstack([self.p["cls"], self.p["cls_b"]]), np.column_stack([self.p["word"], self.p["word_b"]])

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """(class of each target, an order by class, (from, to, first id, id after the last) of the classes met that hold several words)."""
        k = self.cls[target]
        order = np.argsort(k, kind="stable")
        ends = np.searchsorted(k[order], np.arange(self.classes + 1))
        return k, order, [(int(s), int(e), int(lo), int(hi)) for s, e, lo, hi in zip(ends, ends[1:], self.bounds, self.bounds[1:]) if e > s and hi - lo > 1]

    def output(self, h: np.ndarray, target: np.ndarray, steep: bool | None = None) -> np.ndarray:
        """Natural log probability of each target id (a tail class: of the class) after states h."""
        return self._output(np.column_stack([h, np.ones(len(h), h.dtype)]), target, self.steep() if steep is None else steep, *self._weights())

    def _output(self, h: np.ndarray, target: np.ndarray, steep: bool, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
        k, order, met = self._by_class(target)
        out = np.empty(len(k), h.dtype)
        for a in range(0, len(k), TILE):
            s, total = self._softmax(h[a : a + TILE], cls, steep)
            out[a : a + TILE] = np.log(s[np.arange(len(s)), k[a : a + TILE]] / total)
        for a, e, lo, hi in met:
            s, total = self._softmax(h.take(order[a:e], axis=0), word[lo:hi].T, steep)
            out[order[a:e]] += np.log(s[np.arange(e - a), target[order[a:e]] - lo] / total)
        return out

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each id sequence; the end stands before the first id."""
        order = np.argsort([-len(d) for d in docs], kind="stable")
        table = (self.p["embed"] @ self.p["in"] + self.p["in_b"]).astype(np.float32)
        rec_t, steep, weights = np.ascontiguousarray(self.p["rec"].T), self.steep(), self._weights()
        out = np.zeros(len(docs))
        for first in range(0, len(docs), SIDE):
            some = order[first : first + SIDE]
            length = np.array([len(docs[i]) for i in some])
            ids, begin = np.concatenate([docs[i] for i in some]), np.cumsum(length) - length
            total = np.zeros(len(some))
            h = np.zeros((HIDDEN, len(some)), np.float32)
            last = np.zeros(len(some), np.int64)
            for at in range(0, int(length[0]), WINDOW):
                live = np.searchsorted(-length, -np.arange(at, min(at + WINDOW, int(length[0])))).tolist()
                states = np.ones((sum(live), HIDDEN + 1), np.float32)
                owner, target = [], []
                for t, k in enumerate(live):
                    h = self.step(np.ascontiguousarray(table.take(last[:k], axis=0).T), h[:, :k], rec_t)[0]
                    last = ids.take(begin[:k] + (at + t))
                    owner.append(np.arange(k))
                    target.append(last)
                    states[sum(live[:t]) : sum(live[: t + 1]), :HIDDEN] = h.T
                total += np.bincount(np.concatenate(owner), self._output(states, np.concatenate(target), steep, *weights), len(some))
            out[some] = total
        return out

    def fit(self, docs: list[np.ndarray], epochs: int = 3, streams: int = 128, window: int = 20, rate: float = 0.012, clip: float = 1.0) -> Model:
        """Truncated backpropagation through time with Adam; docs end with id 0, after which the state starts anew."""
        if not docs:
            return self
        ids = np.concatenate(docs)
        streams = max(1, min(streams, len(ids) // (2 * window)))
        width = len(ids) // streams
        y_all = ids[: streams * width].reshape(streams, width).T
        x_all = np.vstack([np.zeros((1, streams), np.int64), y_all[:-1]])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        n_all, k, room = epochs * max(1, -(-width // window)), 0, {}
        for _ in range(epochs):
            h = np.zeros((streams, HIDDEN), np.float32)
            for at in range(0, width, window):
                g, h = self._backward(x_all[at : at + window], y_all[at : at + window], h, None, room)
                k += 1
                self._adam(g, m, v2, k, rate * (1 - k / (n_all + 1)), clip)
        return self

    def _adam(self, g: dict, m: dict, v2: dict, k: int, lr: float, clip: float) -> None:
        norm = float(np.sqrt(sum(np.vdot(q, q) for q in g.values())))
        scale = min(1.0, clip / max(norm, 1e-9))
        a, b = lr / (1 - 0.9**k), 1 / (1 - 0.995**k)
        for name, q in g.items():
            q *= scale
            m[name] += 0.1 * (q - m[name])
            q *= q
            q -= v2[name]
            q *= 0.005
            v2[name] += q
            np.multiply(v2[name], b, out=q)
            np.sqrt(q, out=q)
            q += 1e-7
            np.divide(m[name], q, out=q)
            q *= a
            self.p[name] -= q

    def learn(self, docs: Iterable[np.ndarray], rate: float, streams: int = STREAMS, window: int = 20, clip: float = 1.0) -> int:
        """One pass of fit()'s steps over every id of docs, a BLOCK at a time; the number of ids trained on."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        k = done = last = 0
        room: dict = {}

        def train(ids):
            """Trains on as many ids as fill the streams; the rest."""
            nonlocal k, done, last
            n = max(1, min(streams, len(ids) // (2 * window)))
            width = len(ids) // n
            y = ids[: n * width].reshape(n, width).T
            x = np.append(last, ids[: n * width - 1]).reshape(n, width).T
            h, steep = np.zeros((n, HIDDEN), np.float32), self.steep()
            for at in range(0, width, window):
                g, h = self._backward(x[at : at + window], y[at : at + window], h, steep, room)
                k += 1
                self._adam(g, m, v2, k, rate, clip)
            done += n * width
            last = ids[n * width - 1]
            return ids[n * width :]

        some, size = [], 0
        for d in docs:
            some.append(d)
            size += len(d)
            if size >= BLOCK:
                some = [train(np.concatenate(some))]
                size = len(some[0])
        rest = np.concatenate(some) if some else np.zeros(0, np.int64)
        while len(rest):
            rest = train(rest)
        return done

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set_flat(self, a: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = a[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def _backward(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, steep: bool | None = None, room: dict | None = None):
        """Gradients of the mean loss over a window (steps, streams), and the state after it; room keeps the large arrays for the next window."""
        p, (steps, n) = self.p, x.shape
        kind, flat_x, target, rows = p["rec"].dtype, x.ravel(), y.ravel(), x.size
        steep, room = self.steep() if steep is None else steep, {} if room is None else room
        across = lambda m: m.transpose(0, 2, 1)

        def space(name, *shape):
            size = int(np.prod(shape))
            if name not in room or room[name].size < size or room[name].dtype != kind:
                room[name] = np.empty(size, kind)
            return room[name][:size].reshape(shape)

        # biases are weights of a last column of ones
        e = np.column_stack([p["embed"], np.ones(len(p["embed"]), kind)]).take(flat_x, axis=0, out=space("e", rows, EMBED + 1), mode="clip").reshape(steps, n, -1)
        proj = np.matmul(np.vstack([p["in"], p["in_b"]]).T, across(e), out=space("proj", steps, 3 * HIDDEN, n))
        live = (x != 0).astype(kind)
        starts, flat = space("starts", steps, HIDDEN, n), space("flat", rows, HIDDEN + 1)
        flat[:, HIDDEN] = 1
        kept = space("u", steps, 3 * HIDDEN, n), space("zr", steps, 2 * HIDDEN, n), space("n", steps, HIDDEN, n)
        rec, rec_t, h = p["rec"], np.ascontiguousarray(p["rec"].T), h.T
        for t in range(steps):
            np.multiply(h, live[t], out=starts[t])
            h = self.step(proj[t], starts[t], rec_t, tuple(a[t] for a in kept))[0]
            flat[t * n : (t + 1) * n, :HIDDEN] = h.T
        g = {}
        k, order, met = self._by_class(target)
        cls, word = self._weights()
        s, total = self._softmax(flat, cls, steep, space("s", rows, cls.shape[1]))
        s.reshape(-1)[np.arange(rows) * s.shape[1] + k] -= total
        inv = (1 / (total * rows))[:, None]
        scaled = np.multiply(flat, inv, out=space("scaled", rows, HIDDEN + 1))
        d_cls = np.matmul(across(scaled.reshape(steps, n, -1)), s.reshape(steps, n, -1)).sum(axis=0)
        g["cls"], g["cls_b"] = d_cls[:HIDDEN], d_cls[HIDDEN]
        dh = np.matmul(s, p["cls"].T, out=space("dh", rows, HIDDEN))
        dh *= inv
        d_word = np.zeros_like(word)
        hs, ts, inner = flat.take(order, axis=0, out=space("scaled", rows, HIDDEN + 1), mode="clip"), target[order], space("inner", rows, HIDDEN)
        inv, at, done = np.zeros((rows, 1), kind), np.arange(rows), 0
        for a, b, lo, hi in met:
            inner[done:a] = 0
            s, total = self._softmax(hs[a:b], word[lo:hi].T, steep)
            s.reshape(-1)[at[: b - a] * (hi - lo) + (ts[a:b] - lo)] -= total
            inv[a:b, 0] = 1 / (total * rows)
            np.matmul(s.T, hs[a:b] * inv[a:b], out=d_word[lo:hi])
            np.matmul(s, p["word"][lo:hi], out=inner[a:b])
            done = b
        inner[done:] = 0
        inner *= inv
        g["word"], g["word_b"] = np.ascontiguousarray(d_word[:, :HIDDEN]), d_word[:, HIDDEN]
        back_to = np.empty_like(order)
        back_to[order] = at
        dh += inner.take(back_to, axis=0, out=space("scaled", rows, HIDDEN), mode="clip")
        dht = space("inner", steps, HIDDEN, n)
        dht[...] = across(dh.reshape(steps, n, HIDDEN))
        back = np.zeros((HIDDEN, n), kind)
        dproj, du = proj, space("du", steps, 3 * HIDDEN, n)
        for t in range(steps - 1, -1, -1):
            u, c = kept[0][t], kept[2][t]
            z, r = kept[1][t].reshape(2, HIDDEN, n)
            dz, dr, dc = dproj[t].reshape(3, HIDDEN, n)
            d, rest = dht[t], 1 - z
            d += back
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= rest
            dc *= d
            np.subtract(starts[t], c, out=dz)
            dz *= rest
            d *= z
            dz *= d
            np.multiply(u[2 * HIDDEN :], dc, out=dr)
            np.multiply(dc, r, out=du[t, 2 * HIDDEN :])
            np.subtract(1, r, out=rest)
            rest *= r
            dr *= rest
            du[t, : 2 * HIDDEN] = dproj[t, : 2 * HIDDEN]
            back = rec @ du[t]
            back += d
            back *= live[t]
        g["rec"] = np.matmul(du, across(starts)).sum(axis=0).T
        d_in = np.matmul(dproj, e).sum(axis=0)
        g["in"], g["in_b"] = d_in[:, :EMBED].T, d_in[:, EMBED]
        # the gradient of an embedding row is the sum over its places: rows are summed in the order of their ids
        de = np.matmul(across(dproj), p["in"].T, out=space("scaled", steps, n, EMBED)).reshape(-1, EMBED)
        by_id = np.argsort(flat_x.astype(np.uint16), kind="stable")
        ids = flat_x[by_id]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        g["embed"] = np.zeros_like(p["embed"])
        g["embed"][ids[first]] = np.add.reduceat(de.take(by_id, axis=0, out=space("dh", rows, EMBED), mode="clip"), first, axis=0)
        return {name: g[name] for name in p}, h.T


def pieces(batches):
    """The batches' rows in order, in record batches of less than PIECE bytes of text after their first row."""
    return common.pieces(batches, PIECE)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all rows of ``docs(text)``; the empty token is the end, once a row."""

    def run(batches):
        ends = 0
        for piece in pieces(batches):
            ends += piece.num_rows
            found = word_parts(piece)[1].value_counts()
            yield pa.RecordBatch.from_struct_array(found.filter(pc.not_equal(found.field(0), ""))).rename_columns(["token", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends], pa.int64())], ["token", "n"])

    return in_arrow(docs.select("text"), run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def id_arrays(batches, column: int = 0):
    """Each row's model ids."""
    for b in batches:
        for raw in b.column(column).to_pylist():
            yield np.frombuffer(raw, "<u2").astype(np.int64)


def train_round(model: Model, train: DataFrame, rate: float) -> int:
    """Trains model on every row of ``train(ids)``; the number of ids trained on.

    Each partition trains a copy on its rows. The copies meet in PARTS parts by a shuffle, are
    added in the partitions' order, and their mean, weighted by ids, is all that the driver gets.
    """

    def run(batches):
        own = copy.deepcopy(model)
        n = own.learn(id_arrays(batches), rate)
        if n:
            parts = [a.tobytes() for a in np.array_split(own.flat(), PARTS)]
            columns = [pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array([n] * PARTS, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "at", "n", "weights"])

    def mean(batches):
        n: Counter = Counter()
        total: dict = {}
        for b in batches:
            for part, m, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                total[part] = total.get(part, 0.0) + m * np.frombuffer(raw, np.float32).astype(np.float64)
                n[part] += m
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([n[x] for x in total], pa.int64()), pa.array([(total[x] / n[x]).tobytes() for x in total], pa.binary())], ["part", "n", "weights"])

    copies = in_arrow(train.select("ids"), run, "part int, at int, n long, weights binary")
    rows = in_arrow(copies.repartition(PARTS, "part").sortWithinPartitions("part", "at"), mean, "part int, n long, weights binary").collect()
    if not rows:
        return 0
    model.set_flat(np.concatenate([np.frombuffer(r["weights"], np.float64) for r in sorted(rows, key=lambda r: r["part"])]))
    return rows[0]["n"]


class Words:
    """What the corpus's counts say of words: the listed ones' ids, and the tail classes."""

    def __init__(self, counts: DataFrame, frequent: int, known: int):
        # one pass over the counts: by steps of 1/32 of a power of e, and by tail class
        step = F.floor(F.log("n") * 32)
        sub = F.crc32(F.substring(F.encode("token", "UTF-8"), -2, 2)) % TAIL
        groups = counts.where("token <> ''").groupBy(step.alias("step"), sub.alias("sub")).agg(F.sum("n"), F.count("*")).collect()
        self.ends = counts.where("token = ''").agg(F.sum("n")).first()[0] or 0
        self.n_all = self.ends + sum(r[2] for r in groups)
        self.n_words = (self.ends > 0) + sum(r[3] for r in groups)
        # how many words lie at or above each step decides from which count on they are listed
        at_step: Counter = Counter()
        for s, _, _, c in groups:
            at_step[s] += c
        listed_from, total = None, 0
        for s, c in sorted(at_step.items(), reverse=True):
            total += c
            if total > known - 1:
                break
            listed_from = s
        top = counts.where(F.lit(False) if listed_from is None else (F.col("token") != "") & (step >= listed_from)).collect()
        if len(top) < frequent - 1:  # words of classes of their own are told apart by code point, however many have equal counts
            top = counts.where("token <> ''").orderBy(F.desc("n"), "token").limit(frequent - 1).collect()
        top.sort(key=lambda r: (-r[1], r[0]))
        self.frequent = min(frequent, len(top) + 1)
        self.listed = " ".join(r[0] for r in top).encode()
        self.number = np.array([self.ends, *(r[1] for r in top)], np.int64)
        self.sums, kinds = np.zeros(TAIL), np.zeros(TAIL)
        for _, s, a, b in groups:
            self.sums[s] += a
            kinds[s] += b
        for w, n in top[: self.frequent - 1]:  # these have classes of their own
            self.sums[tail_class(w.encode())] -= n
            kinds[tail_class(w.encode())] -= 1
        self.size = self.sums + kinds + 1  # of each tail class

    def index(self):
        """(the listed words by id, the end's as an empty one, and of each id: the model's id, log10 of its share of its tail class, and its base score)."""
        words = self.listed.split()
        cls = np.array([0, *map(tail_class, words)], np.int64)
        own = np.arange(len(cls)) < self.frequent
        to = np.where(own, np.arange(len(cls)), self.frequent + cls)
        share = np.where(own, 0.0, np.log10((self.number + 1) / self.size[cls]))
        return pa.array([b"", *words], pa.binary()).cast(pa.string()), to, share, np.log10((self.number + 1) / (self.n_all + self.n_words + 1))

    def read(self, batches):
        """Rows of doc_id, held_out, draw and text as PREPARED says."""
        listed, *of = self.index()
        to, share, base = (np.append(x, 0) for x in of)  # the last, at -1, is of words that are not listed
        to = to.astype("<u2")
        for b in pieces(batches):
            starts, parts = word_parts(b)
            rows = b.num_rows
            at = pc.index_in(parts, value_set=listed).fill_null(-1).to_numpy()
            row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(starts))
            # words that are not listed: told apart once a piece, counted by text
            away = np.flatnonzero(at < 0)
            owner, kinds = row[away].astype(np.int64), parts.take(pa.array(away)).dictionary_encode()
            del parts
            if not at.all():  # empty parts
                row, at = row[at != 0], at[at != 0]
            tail = np.array([tail_class(x) for x in kinds.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            code = kinds.indices.to_numpy().astype(np.int64)
            n_words, n_away = np.bincount(row, minlength=rows), np.bincount(owner, minlength=rows)
            flat = to[at]
            flat[at < 0] = self.frequent + tail[code]
            ids = np.zeros(len(flat) + rows, "<u2")  # each text's end stays 0
            ids[np.arange(len(flat)) + row] = flat
            end = np.r_[0, np.cumsum(n_words + 1)] * 2
            pair, tf = np.unique(owner * max(1, len(tail)) + code, return_counts=True)
            first, code = pair // max(1, len(tail)), pair % max(1, len(tail))
            rest = pa.StructArray.from_arrays([kinds.dictionary.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(tail[code], pa.int32())], ["token", "tf", "s"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n_words + 1), pa.array(n_words - n_away + int(self.ends > 0)),
                 pa.array(np.bincount(row, base[at], rows) + base[0]), pa.array(np.bincount(row, share[at], rows) + share[0]),
                 pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(end.astype(np.int32)), pa.py_buffer(ids)]),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(first, np.arange(rows + 1)), pa.int32()), rest)],
                ["doc_id", "held_out", "draw", "n_tokens", "n_known", "base_score", "tail", "ids", "rest"],
            )


PREPARED = "held_out boolean, draw long, n_tokens long, n_known long, base_score double, tail double, ids binary, rest array<struct<token:string,tf:long,s:int>>"


def start(model: Model, train: DataFrame, rows: int, stretches: int) -> Model:
    """Fits model on the driver, on about ``stretches`` stretches of at most STRETCH ids, the first by hash, of ``train(draw, ids)`` of so many rows."""
    n = F.ceil(F.length("ids") / (2 * STRETCH)).cast("int")
    all_ = train.agg(F.sum(n)).first()[0] or 0
    drawn = F.filter(F.sequence(F.lit(0), n - 1), lambda k: draw_of(F.col("draw"), k) < share(all_, stretches))
    some = train.select("draw", "ids", F.explode(drawn).alias("k"))
    some = some.select("draw", "k", F.substring("ids", F.col("k") * (2 * STRETCH) + 1, F.lit(2 * STRETCH)).alias("ids")).collect()
    return model.fit([np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in sorted(some, key=lambda r: (r["draw"], r["k"], r["ids"]))])


def lm_score(docs: DataFrame, frequent: int = 2048, known: int = 100_000, fit_stretches: int = 2000, folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training rows are those whose crc32(doc_id) modulo ``folds`` is not ``held_out`` (a null id
    counts as the empty text). A null or empty text is the end alone. Repeated rows count and are
    scored once each. Scores are rounded to 6 decimals. An empty table gives an empty result.
    """
    if frequent + TAIL > 1 << 16:
        raise ValueError(f"frequent may be {(1 << 16) - TAIL} at most: ids are kept in 16 bits")
    held = crc_mod(F.col("doc_id"), folds) == held_out
    counts = written(token_counts(docs.where(~held)))
    words = Words(counts, frequent, known)
    model = Model(words.number[: words.frequent], words.sums)
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", held.alias("held_out"), draw_of(F.lit(4), "doc_id", "text").alias("draw"), "text")
    prepared = written(in_arrow(src, words.read, f"doc_id {kind}, {PREPARED}").withColumn("row", F.monotonically_increasing_id()))
    train = prepared.where(~F.col("held_out"))
    start(model, train, words.ends, fit_stretches)
    trained = sum(train_round(model, train.where(F.pmod("draw", F.lit(ROUNDS)) == r), RATE * (1 - r / ROUNDS)) for r in range(ROUNDS))
    if trained != words.n_all:
        raise RuntimeError(f"trained on {trained} of {words.n_all} words")

    def score(batches):
        for b in batches:
            seqs = list(id_arrays([b], 1))
            out = model.score(seqs) / np.log(10) if seqs else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["row", "model_score"])

    scored = in_arrow(prepared.select("row", "ids"), score, "row long, model_score double")
    rest = prepared.select("row", F.explode("rest").alias("x")).select("row", "x.token", "x.tf", "x.s")
    room = F.element_at(F.array(*[F.lit(float(x)) for x in words.size]), F.col("s") + 1)
    c = F.coalesce("n", F.lit(0))
    late = rest.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(words.n_all + words.n_words + 1)))).alias("base"),
        F.sum(F.col("tf") * F.log10((c + 1) / room)).alias("late_tail"),
    )
    add = lambda a, *b: sum((F.coalesce(x, F.lit(0)) for x in b), F.col(a))
    return prepared.drop("rest", "ids").join(scored, "row").join(late, "row", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "known").alias("n_known"), F.lit(int(words.n_all)).cast("long").alias("train_tokens"),
        F.round(add("base_score", "base"), 6).alias("base_score"), F.round(add("model_score", "tail", "late_tail"), 6).alias("score"),
    )
