"""Secret scans: fixed patterns, and a linear-chain conditional random field over words.

Words are tagged begin (B), inside (I) or outside (O) of a secret. A word's features are its
shape, the shapes of the words before and after it, these words themselves, hashed, and how much
of the file has secret-like shapes. All are classes, so a word's scores are table lookups. Decoding is exact
Viterbi: a word whose O score beats B and I by more than transitions can ever return is O in the
best path, and cuts the text into short stretches that are decoded one by one.

The field is fitted here, on stretches that the fixed patterns label. Texts of any length are cut
into passages of PASSAGE code points for this, and a bounded number of passages is drawn: about
``fit_passages`` of those with each kind of pattern, and as many of those with none.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import draw_of, in_arrow

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'`.,;:()[]{}<>#*$%&|!?="
B, I, O = 0, 1, 2
LEAST = 8  # code points of a span that the field may add
HALF = 12  # words on either side of a secret in a training stretch
PASSAGE = 20_000


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def shape(word: str) -> int:
    """The word's shape class, below SHAPES."""
    core = word.strip(EDGES)
    n = len(core)
    if n < 24 and core.isalpha() and (n < 5 or not any(k in core.lower() for k in KEYS)):
        case = 0 if core.islower() or not (core.isupper() or core.lower() != core) else 1 if core[1:].islower() or n == 1 else 2 if core.isupper() else 3
        size = 1 if n < 4 else 2 if n < 8 else 3 if n < 12 else 4 if n < 16 else 5
        return 4 + (size * 16 + case) * 12 + core.isascii()
    size = 0 if n == 0 else 1 if n < 4 else 2 if n < 8 else 3 if n < 12 else 4 if n < 16 else 5 if n < 24 else 6 if n < 48 else 7
    if not core:  # marks alone: an assignment sign or not
        return 1 if "=" in word or word.endswith(":") else 0
    plain = core.isascii()
    digits = sum(map(str.isdigit, core)) if not core.isalpha() else 0
    upper = core.lower() != core
    lower = core.upper() != core
    mix = 0 if digits == 0 else 3 if digits == n else 1 if digits * 4 < n else 2
    marks = 0 if core.isalnum() else 1 if re.fullmatch(r"[A-Za-z0-9+/_=-]+", core) else 2
    hexa = 1 if plain and digits and re.fullmatch(r"[0-9a-f]+", core) else 0
    if any(k in core.lower() for k in KEYS) and n < 24:
        return 2 + (1 if word[-1] in "=:" else 0)
    title = 1 if upper and core[0] != core[0].lower() and core[1:] == core[1:].lower() else 0
    case = 0 if not upper else 1 if title else 2 if not lower else 3
    out = size
    for k, base in ((mix, 4), (case, 4), (marks, 3), (hexa, 2), (int(plain), 2)):
        out = out * base + k
    return 4 + out


SHAPES = 4 + 8 * 4 * 4 * 3 * 2 * 2
#: A shape's single traits; a table's row for a shape is its own weight plus those of its traits.
TRAITS = (8, 4, 4, 3, 2, 2)


def traits() -> np.ndarray:
    """(SHAPES + 1, sum(TRAITS)): 1 where a shape has a trait."""
    out = np.zeros((SHAPES + 1, sum(TRAITS)))
    s = np.arange(SHAPES - 4)
    for k in range(len(TRAITS) - 1, -1, -1):
        out[4 + np.arange(len(s)), sum(TRAITS[:k]) + s % TRAITS[k]] = 1
        s //= TRAITS[k]
    return out


#: Classes of words by hash; one more stands for the text's edge.
HASHED = 512


def hashed(word: str) -> int:
    """The class of the word's core in lower case, whatever marks are around it."""
    return zlib.crc32(word.strip(EDGES).lower().encode("utf-8", "surrogatepass")) % HASHED


class Shapes(dict):
    """Words' shapes and hashed classes as one number, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[w] = out = shape(w) * HASHED + hashed(w)
        return out

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shapes, hashed classes) of the words."""
        return np.divmod(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), HASHED)


def suspicious() -> np.ndarray:
    """Shape classes with long cores that hold digits: what the file feature counts."""
    s = np.arange(SHAPES) - 4
    size, mix = s // 192, (s // 48) % 4
    return (s >= 0) & (size >= 4) & (mix > 0)


def file_level(shapes: np.ndarray, odd: np.ndarray) -> int:
    """0 to 3: how many of the file's words look odd (none, below 1 %, below 10 %, more)."""
    n = int(odd[shapes].sum())
    return 0 if not n else 1 if n * 100 < len(shapes) else 2 if n * 10 < len(shapes) else 3


class Field:
    """Scores of a linear-chain conditional random field with labels B, I, O."""

    def __init__(self):
        self.own = np.zeros((SHAPES + 1, 3))  # the last row stands for the text's edge
        self.before = np.zeros((SHAPES + 1, 3))
        self.after = np.zeros((SHAPES + 1, 3))
        self.word_before = np.zeros((HASHED + 1, 3))
        self.word_after = np.zeros((HASHED + 1, 3))
        self.file = np.zeros((4, 3))
        self.moves = np.zeros((3, 3))
        self.first = np.zeros(3)

    def gain(self) -> list[float]:
        """The most that labels B and I of one word can win over O by the transitions beside it."""
        t = self.moves
        return [max(float((t[:, y] - t[:, O]).max()), float(self.first[y] - self.first[O])) + max(float((t[y] - t[O]).max()), 0.0) for y in (B, I)]

    def margins(self) -> tuple[np.ndarray, ...]:
        """Per table, how far O is above the better of B and I less gain(); their sum bounds a word's margin from below."""
        lift = np.array([*self.gain(), 0.0])
        least = lambda x: (x[:, [O]] - x)[:, [B, I]].min(axis=1)
        return least(self.own + lift), least(self.before), least(self.after), least(self.word_before), least(self.word_after), least(self.file)

    def tags(self, shapes: np.ndarray, level: int, bounds: tuple[np.ndarray, ...], words: np.ndarray | None = None) -> np.ndarray:
        """Labels of the best path, by shapes and, if given, hashed words; words that are surely O never reach the decoder."""
        words = np.full(len(shapes), HASHED) if words is None else words
        own, before, after, word_before, word_after, file = bounds
        edge, beside = np.r_[SHAPES, shapes, SHAPES], np.r_[HASHED, words, HASHED]
        open_ = np.flatnonzero(own[shapes] + before[edge[:-2]] + after[edge[2:]] + word_before[beside[:-2]] + word_after[beside[2:]] + file[level] <= 1e-9)
        out = np.full(len(shapes), O, np.int8)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            s, t = int(run[0]), int(run[-1]) + 1
            near, word = edge[s : t + 2], beside[s : t + 2]
            e = self.own[near[1:-1]] + self.before[near[:-2]] + self.after[near[2:]] + self.word_before[word[:-2]] + self.word_after[word[2:]] + self.file[level]
            out[s:t] = self._stretch(e, s == 0, t == len(shapes))
        return out

    def expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of scores (stretches, words, labels), by forward and backward sums over all paths: (each word's label probabilities, each move's, log of the sum over paths)."""
        n, t, _ = e.shape
        fwd = np.empty((n, t, 3))
        fwd[:, 0] = e[:, 0] + self.first
        for i in range(1, t):
            fwd[:, i] = np.logaddexp.reduce(fwd[:, i - 1, :, None] + self.moves, axis=1) + e[:, i]
        bwd = np.zeros((n, t, 3))
        for i in range(t - 2, -1, -1):
            bwd[:, i] = np.logaddexp.reduce(self.moves + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        pair = np.exp(fwd[:, :-1, :, None] + self.moves + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        return np.exp(fwd + bwd - z[:, None, None]), pair, z

    def fit(self, x: np.ndarray, left: np.ndarray, right: np.ndarray, words: np.ndarray, level: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.15, decay: float = 1e-4, word_decay: float = 1e-2) -> Field:
        """x, left, right, y: (stretches, words), all stretches of one length; words: the hashed words on both sides, (stretches, words + 2). Adam on the log-likelihood."""
        n = len(x)
        kinds = traits()
        tables = [np.zeros((SHAPES + 1, 3)) for _ in range(3)]
        shared = [np.zeros((kinds.shape[1], 3)) for _ in range(3)]
        weights = [*tables, *shared, self.word_before, self.word_after, self.file, self.moves, self.first]
        m = [np.zeros_like(p) for p in weights]
        v = [np.zeros_like(p) for p in weights]
        one = np.eye(3)[y]
        word_left, word_right = words[:, :-2], words[:, 2:]
        for k in range(1, rounds + 1):
            self.own, self.before, self.after = (a + kinds @ b for a, b in zip(tables, shared))
            e = self.own[x] + self.before[left] + self.after[right] + self.word_before[word_left] + self.word_after[word_right] + self.file[level][:, None]
            share, pair, _ = self.expected(e)
            d, pair = share - one, pair.sum(axis=(0, 1))
            np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            add = lambda at, size: np.stack([np.bincount(at.ravel(), d[..., c].ravel(), size) for c in range(3)], axis=1)
            grads = [add(at, SHAPES + 1) for at in (x, left, right)]
            grads += [kinds.T @ g for g in grads]
            grads += [add(at, HASHED + 1) for at in (word_left, word_right)]
            g = np.zeros_like(self.file)
            np.add.at(g, level, d.sum(axis=1))
            grads += [g, pair, d[:, 0].sum(axis=0)]
            for p, g, a, b in zip(weights, grads, m, v):
                g = g / n + (word_decay if p is self.word_before or p is self.word_after else decay) * p
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
        self.own, self.before, self.after = (a + kinds @ b for a, b in zip(tables, shared))
        return self

    def _stretch(self, e: np.ndarray, at_start: bool, at_end: bool) -> list[int]:
        """Viterbi over words that lie between words labelled O, or at an end of the text."""
        moves, rows = self.moves.tolist(), e.tolist()
        entry = (self.first if at_start else self.moves[O]).tolist()
        score = [x + y for x, y in zip(rows[0], entry)]
        back = []
        for ei in rows[1:]:
            row = [max((B, I, O), key=lambda p: score[p] + moves[p][y]) for y in (B, I, O)]
            score = [score[p] + moves[p][y] + ei[y] for y, p in enumerate(row)]
            back.append(row)
        if not at_end:
            score = [score[p] + moves[p][O] for p in (B, I, O)]
        out = [max((B, I, O), key=lambda p: score[p])]
        for row in reversed(back):
            out.append(row[out[-1]])
        return out[::-1]


def _labelled(text: str):
    """(starts, ends, labels) of a text's words by the fixed patterns."""
    ms = list(WORD.finditer(text))
    a = np.array([m.start() for m in ms], np.int64)
    b = np.array([m.end() for m in ms], np.int64)
    y = np.full(len(ms), O, np.int8)
    for start, _, end, _ in sorted(base_spans(text), key=lambda s: s[0] - s[2]):
        i, j = int(np.searchsorted(b, start, side="right")), int(np.searchsorted(a, end))
        if i < j and (y[i:j] == O).all():
            y[i:j] = I
            y[i] = B
    return [m.group() for m in ms], a, b, y


ALPHABETS = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]


def _other(w: list[str], y: np.ndarray, rng) -> list[str]:
    """The words, with the labelled secrets' values written in other alphabets and lengths."""

    def value(_):
        letters = ALPHABETS[int(rng.integers(len(ALPHABETS)))]
        return "".join(letters[k] for k in rng.integers(0, len(letters), int(rng.integers(16, 49))))

    return [x if t == O else re.sub(r"[A-Za-z0-9+/_.=-]{12,}", value, x) for x, t in zip(w, y)]


def stretches(docs: list[str], seed: int = 7):
    """Training stretches: around every labelled secret, as it is and in another alphabet, and as many at random places."""
    rng = np.random.default_rng(seed)
    odd, rows = suspicious(), []
    for text in docs:
        w, _, _, y = _labelled(text)
        if not w:
            continue
        s = np.array([shape(x) for x in w])
        level = file_level(s, odd)
        middle = np.r_[np.flatnonzero(y == B), rng.integers(0, len(w), 3 + int((y == B).sum()))]
        tags = np.r_[np.full(HALF + 1, O), y, np.full(HALF + 1, O)]
        for words in (w, _other(w, y, rng)) if (y != O).any() else (w,):
            pad = np.r_[np.full(HALF + 1, SHAPES), [shape(x) for x in words], np.full(HALF + 1, SHAPES)]
            near = np.r_[np.full(HALF + 1, HASHED), [hashed(x) for x in words], np.full(HALF + 1, HASHED)]
            for c in middle:
                at = slice(c + 1, c + 2 * HALF + 2)
                rows.append((pad[at], pad[c : c + 2 * HALF + 1], pad[c + 2 : c + 2 * HALF + 3], near[c : c + 2 * HALF + 3], level, tags[at]))
    if not rows:
        return None
    return tuple(np.array(x) for x in zip(*rows))


def _doc_draw() -> Column:
    return draw_of(F.lit(3), "doc_id", "text")


def passages(docs: DataFrame) -> DataFrame:
    """draw, text and kind of all passages of the texts; kind is the rarest that the fixed patterns find, or none."""
    cut = docs.select(_doc_draw().alias("draw"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))).alias("k", "text"))
    assign = F.lower("text").rlike(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[a-z0-9+/_.=-]{12}")
    kind = F.when(F.col("text").contains("AKIA") & F.col("text").rlike("AKIA[A-Z0-9]{14}"), "access").when(assign, "assign").when(F.col("text").rlike("[0-9a-f]{16}"), "hex").otherwise("none")
    return cut.select(draw_of("draw", "k").alias("draw"), "text", kind.alias("kind"))


def _step(draw: Column) -> Column:
    """Steps of a twelfth of a power of two, so that the least draws of any number of rows are told apart."""
    return F.floor(F.log2(draw + 1) * 12).cast("int")


def fit_field(docs: DataFrame, fit_passages: int = 200) -> Field:
    """The field of about ``fit_passages`` passages of each kind (of those without a pattern, of as many as of all others), those of the least draws.

    The patterns run over the corpus once: passages are counted by kind and by step of their draw.
    Then only texts with a passage below its bound are cut again.
    """
    counts: dict[str, dict[int, int]] = {}
    for kind, step, n in passages(docs).groupBy("kind", _step(F.col("draw")).alias("step")).count().collect():  # a few hundred steps a kind
        counts.setdefault(kind, {})[step] = n
    bound, most = F.lit(-1), -1
    for kind, steps in sorted(counts.items()):
        want, total, last = fit_passages if kind != "none" else fit_passages * max(1, len(counts) - 1), 0, -1
        for step, n in sorted(steps.items()):
            if total >= want:
                break
            total, last = total + n, step
        bound, most = F.when(F.col("kind") == kind, F.lit(last)).otherwise(bound), max(most, last)
    # a text's passages have the draws that its own and their numbers give
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / PASSAGE).cast("int") - 1, F.lit(0)))
    near = docs.select("doc_id", "text", _doc_draw().alias("d")).where(F.exists(numbers, lambda k: _step(draw_of("d", k)) <= most))
    some = passages(near).where(_step(F.col("draw")) <= bound).select("draw", "text").dropDuplicates(["draw"]).collect()
    data = stretches([r[1] for r in sorted(some)])
    field = Field()
    if data is None:
        field.own[:, O] = 1.0
        return field
    return field.fit(*data)


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the union of (start, end) spans, in order and disjoint."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan(text: str, field: Field, shapes: Shapes, odd: np.ndarray, bounds: tuple[np.ndarray, ...]) -> tuple[list, list]:
    """(base spans, spans the field adds) of a text; added ones touch no base span."""
    base = base_spans(text)
    w = WORD.findall(text)
    if not w:
        return base, []
    s, h = shapes.of(w)
    y = field.tags(s, file_level(s, odd), bounds, h)
    begins = np.flatnonzero(y == B)
    inner = np.flatnonzero((y == I) & (np.r_[O, y[:-1]] == O))
    begins = np.sort(np.r_[begins, inner])
    if not len(begins):
        return base, []
    ms = list(WORD.finditer(text))
    starts, ends = merged([(a, b) for a, _, b, _ in base])
    added = []
    for i in begins.tolist():
        j = i + 1
        while j < len(y) and y[j] == I:
            j += 1
        start, end = ms[i].start(), ms[j - 1].end()
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        near = bisect_left(starts, end) - 1  # the last base stretch that begins before the end
        if end - start >= LEAST and (near < 0 or ends[near] <= start):
            added.append((start, "crf", end, start))
    return base, added


def _line(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b, _ in spans)


def redacted(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """The text with every secret's value replaced; overlapping values are one."""
    out, at = [], 0
    for v, end in sorted((v, e) for _, _, e, v in spans):
        if v >= at:
            out += [text[at:v], mark]
            at = end
        else:
            at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, redact: bool = False, fit_passages: int = 200) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    With ``redact`` instead the rows of ``docs``, all columns, secrets' values replaced in text.
    Offsets are code points of the whole text. A null text is empty (and stays null when
    redacted). Repeated rows give repeated rows; an empty table gives an empty result.
    """
    field = fit_field(docs, fit_passages)
    columns = docs.columns if redact else ["doc_id", "text"]
    src = docs.select(*columns)
    at = columns.index("text")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]

    def run(batches):
        shapes, odd, bounds = Shapes(), suspicious(), field.margins()
        for b in batches:
            raw = b.column(at).to_pylist()
            found = [scan(t or "", field, shapes, odd, bounds) for t in raw]
            if redact:
                new = pa.array([t if t is None else redacted(t, x + y) for t, (x, y) in zip(raw, found)], pa.string())
                yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(len(columns))], columns)
                continue
            count = [pa.array([sum(s[1] == k for s in x) for x, _ in found], pa.int64()) for k in KINDS[:3]]
            sha = [hashlib.sha256(_line(x).encode()).hexdigest() for x, _ in found]
            both = [_line(sorted(x + y, key=lambda s: (s[0], KINDS.index(s[1])))) for x, y in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *count, pa.array(sha, pa.string()), pa.array(both, pa.string()), pa.array([len(y) for _, y in found], pa.int64())], names)

    if redact:
        return in_arrow(src, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(src, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
