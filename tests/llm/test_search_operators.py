"""Operators 11 to 13 against brute force, and over awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lexora.llm import lexical, periodic, pivots
from lexora.llm.queries import ORACLE, QUERIES

from ..oracle import sql_rows
from .test_operators import AWKWARD, LONG, SF, SHAPE, doc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SHAPE)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


# ------------------------------------------------------------ 11


def brute_runs(w, least=6, exponent=4):
    """(start, end, period) by comparing all words with those each period before."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, e, q) for (a, e), q in found.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_digests(doc_id, text):
    w = WORD.findall(text or "")
    w = planted(doc_id, w) if doc_id is not None else w
    runs = brute_runs(w)
    drop = {i for a, e, q in runs for i in range(a + q, e)}
    best = min(((a - e, a, q) for a, e, q in runs), default=None)
    longest = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *longest, sha("".join(f"{a},{e - a},{q}\n" for a, e, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def key_of(row):
    return tuple((x is None, x) for x in row)


def test_runs_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, SF).collect()), key=key_of)
    want = sorted((brute_digests(r["doc_id"], r["text"]) for r in docs), key=key_of)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5


REPEATS = [
    doc(20, "a b " * 9 + "c " + "a b " * 9), doc(21, "x " * 5), doc(22, "x " * 6), doc(23, "\t".join("pqr" * 3) + " p q"), doc(24, "\t".join("pqr" * 4)),
    doc(25, " ".join(("u v w " * 5 + "z y u u u u u u x ") * 6)), doc(26, ("h i j k l m n " * 4 + "o p ") * 5), doc(27, "İ ß İ ß İ ß İ ß É"), doc(None, "n " * 40), doc(28, "n " * 40), doc(28, "n " * 40),
]


def test_runs_of_awkward_rows(spark, awkward, empty):
    """Nulls, empty and very long texts, repeated rows, runs inside of copied stretches, a run that is the whole text, clashing columns."""
    rows = awkward.union(spark.createDataFrame(REPEATS, SHAPE))
    got = sorted(map(tuple, periodic.run_digests(periodic.find_runs(periodic.with_planted_repeats(rows))).collect()), key=key_of)
    brief = lambda i, t: brute_digests(i, t) if t != LONG else None
    want = sorted((brief(r[0], r[1]) for r in AWKWARD + REPEATS if r[1] != LONG), key=key_of)
    assert [r for r in got if r[0] != 4] == want
    assert [r[1:6] for r in got if r[0] == 4] == ([(1, 0, 30_000, 1, 30_000_000)] if zlib.crc32(b"4") % 10 else [r[1:6] for r in got if r[0] == 4])
    assert periodic.run_digests(periodic.find_runs(periodic.with_planted_repeats(empty))).count() == 0


def test_runs_with_texts_apart(spark):
    """Texts that share a suffix array do not see one another, wherever a batch is cut."""
    rows = spark.createDataFrame(REPEATS * 3, SHAPE)
    whole = sorted(map(str, periodic.find_runs(rows.coalesce(1)).collect()))
    kept, periodic.TOGETHER = periodic.TOGETHER, 16
    try:
        assert sorted(map(str, periodic.find_runs(rows.repartition(5)).collect())) == whole
    finally:
        periodic.TOGETHER = kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=7), st.sampled_from([2, 3, 4]), st.sampled_from([1, 2, 6]))
def test_runs_by_blocks(parts, exponent, least):
    """Every run, by suffix array, blocks, edges and copies, of sequences that are full of them."""
    w = [x for part, times in parts for x in part * times]
    assert sorted(periodic.all_runs(np.array(w, np.int64), least, exponent)) == brute_runs(w, least, exponent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_longest_previous_factor(w):
    s = np.array(w, np.int64)
    sa, levels = periodic.suffixes(s)
    assert sa.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
    lpf, source = periodic.longest_previous(s, sa, levels)
    for i in range(len(w)):
        best = max((k for j in range(i) for k in range(len(w) - i + 1) if w[j : j + k] == w[i : i + k]), default=0)
        assert lpf[i] == best and (not best or (source[i] < i and w[source[i] : source[i] + best] == w[i : i + best]))


# ------------------------------------------------------------ 13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, k, once=True):
    """(item, rank, doc_id, score) with Python's integers."""
    docs = [(i, Counter(terms_of(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for item, q in asked.items():
        scored = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum((1 if once else n) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, n in q.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, r, x[2], x[3]) for r, x in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=key_of)


def ranked(df):
    return sorted(map(tuple, df.collect()), key=key_of)


def test_ranks_of_a_table(spark):
    """The query against its SQL, and both against brute force."""
    got = ranked(QUERIES["op13_lexical_search"](spark, SF))
    names, rows = sql_rows(SF, ORACLE["op13_lexical_search"])
    order = [names.index(c) for c in ("item_id", "rank", "doc_id", "score")]
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    assert got == sorted((tuple(r[i] for i in order) for r in rows), key=key_of) == brute_ranks(read("documents", "doc_id"), read("benchmark", "item_id"), 50)


ITEMS = [(1, "fox FOX dog, tree"), (2, None), (3, ""), (4, "é 日本 İ ß ı"), (None, "lazy word"), (5, "end more"), (5, "Also fox"), (6, "nowhere"), (7, ":;- \x7f")]


@pytest.mark.parametrize("once", [True, False])
def test_ranks_of_awkward_rows(spark, awkward, empty, once):
    """Nulls, empty and long texts, repeated documents and items, ties at the cut, terms of no document, clashing columns, items in many groups."""
    items = spark.createDataFrame([(i, t, 0, 0, 0.0) for i, t in ITEMS], "item_id long, text string, doc_id int, i int, rank double")
    want = brute_ranks([r[:2] for r in AWKWARD], ITEMS, 3, once)
    assert ranked(lexical.rank_documents(awkward, items, 3, once=once)) == want
    assert ranked(lexical.rank_documents(awkward, items, 3, once=once, group_bytes=100)) == want
    assert lexical.rank_documents(empty, items, 3).count() == lexical.rank_documents(awkward, items.where("false"), 3).count() == 0


def test_ranks_by_blocks(spark):
    """Blocks of few documents, pieces of few bytes and many tasks give the same ranks; equal scores go by id."""
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(400)]
    items = [(j, f"w{j} w{j + 1} W{j}") for j in range(7)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")
    kept, lexical.BLOCK, lexical.TOGETHER = (lexical.BLOCK, lexical.TOGETHER), 5, 40
    try:
        got = ranked(lexical.rank_documents(*frames, 20))
    finally:
        lexical.BLOCK, lexical.TOGETHER = kept
    assert got == brute_ranks(docs, items, 20)


def test_impacts_of_vast_tables():
    """Products beyond 64 bits are taken without overflow."""
    n, tf = np.array([10**6, 3]), np.array([5, 1])
    got = lexical.impacts(np.array([7000, 12]), n, tf, 10**13, 3 * 10**15)
    want = [w * (10**9 * t // (1000 * t + 20 * (50 + 50 * x * 10**13 // (3 * 10**15)))) for w, x, t in ((7000, 10**6, 5), (12, 3, 1))]
    assert got.tolist() == want


# ------------------------------------------------------------ 12

VECTORS = "vec_id long, embedding array<float>, label int, seg int, `row` string, v int"


def brute_nearest(rows, k, asked=lambda i: i % 50 == 0):
    """(query_id, rank, vec_id, score) by comparing every query with every row."""
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if asked(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def searched(spark, rows, k=5, **options):
    frame = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in rows], VECTORS)
    return sorted(map(tuple, pivots.nearest(frame, F.col("vec_id") % 50 == 0, k, **options).collect()))


def test_nearest_of_a_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op12_vector_search"](spark, SF).collect()))
    names, by_sql = sql_rows(SF, ORACLE["op12_vector_search"])
    order = [names.index(c) for c in ("query_id", "rank", "vec_id", "score")]
    assert got == brute_nearest(rows, 5) == sorted(tuple(r[i] for i in order) for r in by_sql)


def test_nearest_of_awkward_rows(spark):
    """Nulls, no and non-finite components, lengths that differ, zero and opposite vectors, ties, repeated rows and ids."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [-1.0, 0.5, 3.0]), (50, [0.0, 0.0]), (100, []), (150, None), (200, [1.0, None]), (250, [nan, 1.0]), (300, [inf]), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 2.0]) for i in range(1, 9)] + [(i, [-1.0, -2.0]) for i in (11, 12)] + [(13, [0.001, -0.001]), (14, [3e4, -3e4, 1.0]), (15, []), (16, [0.0]), (17, None)]
    for options in ({}, {"pivots": 1}, {"segment": 1}, {"sample": 1}):
        assert searched(spark, rows, 5, **options) == brute_nearest(rows, 5)
    assert searched(spark, rows, 100) == brute_nearest(rows, 100)
    assert searched(spark, rows[-2:]) == searched(spark, []) == [] and searched(spark, [(50, [1.0])]) == []


def test_nearest_with_a_common_vector(spark, monkeypatch):
    """A third of the rows are one vector: segments are split, ties at the cut go by id, nothing is lost."""
    monkeypatch.setattr(pivots, "LEAST_ROWS", 8)
    rng = np.random.default_rng(3)
    some = rng.normal(size=(400, 6)).round(2)
    rows = [(i, [0.5, -0.25, 1.0, 0.0, 0.0, 0.125] if i % 3 == 0 else some[i].tolist()) for i in range(400)]
    assert searched(spark, rows, 7, pivots=4) == brute_nearest(rows, 7)


def test_bounds_rule_out_candidates():
    """In few dimensions most rows are never scored, and no row of a score that counts is ruled out."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 300, size=(5000, 3)).round().astype(np.int64)
    norms, table = pivots.angles(x, pivots.choose(x[:500], 32))
    own = pivots.Segment(np.arange(5000), x, norms, table)
    for i in range(0, 5000, 250):
        scores, ids = own.best(5, i, x[i], float(norms[i]), table[i], pivots.NO_SCORE)
        want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
        assert list(zip((-scores).tolist(), ids.tolist())) == want
    assert own.scored < 0.2 * 20 * 5000


def test_products_beyond_doubles():
    """Sums that doubles do not hold are taken in integers."""
    x = np.array([[2**30 + 1, 1], [2**30, 3]], np.int64)
    assert pivots.dots(x, np.array([2**30 + 1, -1])).tolist() == [(2**30 + 1) ** 2 - 1, 2**30 * (2**30 + 1) - 3]
    norms, table = pivots.angles(x, x)
    scores, _ = pivots.Segment(np.arange(2), x, norms, table).best(2, 9, x[0], float(norms[0]), table[0], pivots.NO_SCORE)
    assert scores.tolist() == [(2**30 + 1) ** 2 + 1, 2**30 * (2**30 + 1) + 3]
