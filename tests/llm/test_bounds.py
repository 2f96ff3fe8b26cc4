"""Bounds of what models are fitted on, and what is left behind."""

import itertools
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexora.llm import lm, secrets, simhash, toxicity
from lexora.llm.common import as_read, by_part, rows_of_part

ROOT = Path(__file__).resolve().parents[2]


def test_words_of_one_count(spark):
    """However many words have equal counts, those of classes of their own are the first by code point."""
    rows = [("", 9), *((f"w{i:03d}", 4) for i in range(50))]
    counts = spark.createDataFrame(rows, "token string, n long")
    for known in (20, 100):
        w = lm.Words(counts, 11, known)
        assert w.frequent == 11 and w.listed.split()[:10] == [f"w{i:03d}".encode() for i in range(10)]
        assert w.n_all == 9 + 200 and w.n_words == 51 and abs(w.sums.sum() - 4 * 40) < 1e-9


def test_ids_fit_their_width(spark):
    with pytest.raises(ValueError, match="65504"):
        lm.lm_score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), frequent=70_000)


def test_nothing_is_left_in_the_checkpoint_folder(tmp_path):
    """Where the session names a folder, tables and checkpoints in it go when the application ends."""
    code = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()\n"
        "from lexora.llm.common import saved, written\n"
        "d = saved(s.range(100)); t = written(d); assert d.count() == t.count() == 100\n"
        f"import os; assert sum(len(f) for _, _, f in os.walk('{tmp_path}/shared'))\n"
        "s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env={"PATH": "/usr/local/bin:/usr/bin:/bin", "PYTHONPATH": str(ROOT), "HOME": str(tmp_path)})
    assert [str(p) for p in (tmp_path / "shared").rglob("*") if p.is_file()] == []


def test_a_huge_labelled_text_stays_away_from_the_driver(spark, monkeypatch):
    """The driver gets hashes alone, and a text of more words than the bound is left out whole; the others train the net."""
    rows = [(i, "you awful stupid fool go away now" if i % 2 else "a calm and pleasant walk by the sea") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.range(1).select(F.lit(100).cast("long"), F.repeat(F.lit("awful words "), 500_000)))
    some = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert dict(toxicity.hashed_rows(docs, some).dtypes)["words"] == "binary" and "text" not in toxicity.hashed_rows(docs, some).columns
    seen = []
    monkeypatch.setattr(toxicity.Net, "fit", lambda self, rows, y: seen.append((len(rows), sum(map(len, rows)))) or self)
    assert toxicity.train(docs, some, 10_000) is not None and seen == [(40, 20 * 7 + 20 * 8)]
    toxicity.train(docs, some, 2_000_000)
    assert seen[1] == (41, 300 + 1_000_000)
    assert toxicity.train(docs.where("doc_id < 3"), some, 10_000) is None


def test_least_draws_of_each_kind(spark):
    """The field's passages are those of the least draws of their kind; texts without one are not cut again."""
    docs = spark.createDataFrame([(i, f"plain words {i} " * 30 + ("password = abcdEFGH12345678" if i % 10 == 0 else "")) for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string")
    seen = {}
    field = secrets.stretches
    try:
        secrets.stretches = lambda texts, seed=7: seen.setdefault("texts", texts) and None
        secrets.fit_field(docs, 5)
    finally:
        secrets.stretches = field
    p = [tuple(r) for r in secrets.passages(docs).select("draw", "kind", "text").collect()]
    for kind in ("assign", "none"):
        own = sorted(d for d, k, _ in p if k == kind)
        taken = sorted(d for d, k, t in p if k == kind and t in seen["texts"])
        assert 5 <= len(taken) <= 12 and taken == own[: len(taken)]
    assert len(seen["texts"]) == len(set(seen["texts"]))
    assert np.isfinite(secrets.fit_field(docs.limit(0)).own).all()


def test_forward_and_backward_sums_are_those_of_all_paths():
    """Label and move probabilities against the sum over all paths, of stretches of up to five words."""
    rng = np.random.default_rng(12)
    for n in range(1, 6):
        f = secrets.Field()
        f.moves, f.first = rng.normal(size=(3, 3)), rng.normal(size=3)
        e = rng.normal(size=(2, n, 3))
        label, pair, z = f.expected(e)
        for s in range(2):
            paths = list(itertools.product(range(3), repeat=n))
            w = np.exp([f.first[y[0]] + sum(e[s, i, y[i]] for i in range(n)) + sum(f.moves[y[i - 1], y[i]] for i in range(1, n)) for y in paths])
            assert np.isclose(z[s], np.log(w.sum()))
            for i, k in itertools.product(range(n), range(3)):
                assert np.isclose(label[s, i, k], sum(x for x, y in zip(w, paths) if y[i] == k) / w.sum())
            for i, a, b in itertools.product(range(n - 1), range(3), range(3)):
                assert np.isclose(pair[s, i, a, b], sum(x for x, y in zip(w, paths) if (y[i], y[i + 1]) == (a, b)) / w.sum())


def test_the_field_sees_neighbouring_words():
    """Two words of one shape: only that after 'key' is a secret. Shapes cannot tell them apart, the words before can."""
    rng = np.random.default_rng(13)
    draw = lambda: "".join("abcdefghijkmnpqrstuvwxyz23456789"[k] for k in rng.integers(0, 32, 20))
    t = 2 * secrets.HALF + 1
    rows, tags = [], []
    for i in range(60):
        words = ["some"] * t
        words[10], words[11] = ("code" if i % 2 else "page"), draw()
        rows.append(words)
        tags.append([secrets.B if i % 2 and k == 11 else secrets.O for k in range(t)])
    shapes = np.array([[secrets.SHAPES, *map(secrets.shape, w), secrets.SHAPES] for w in rows])
    words = np.array([[secrets.HASHED, *map(secrets.hashed, w), secrets.HASHED] for w in rows])
    f = secrets.Field().fit(shapes[:, 1:-1], shapes[:, :-2], shapes[:, 2:], words, np.zeros(60, int), np.array(tags), rounds=200)
    bounds, seen = f.margins(), secrets.Shapes()
    for before, want in (("code", secrets.B), ("page", secrets.O)):
        s, h = seen.of(["some"] * 10 + [before, draw()] + ["some"] * 5)
        assert f.tags(s, 0, bounds, h)[11] == want


def test_rows_of_input_parts(spark, tmp_path):
    """A side table is read by part, those without rows too; a frame that comes from an exchange is written first."""
    side = spark.range(1000).select(((F.col("id") % 200) * (1 << 33) + F.col("id") / 200).cast("long").alias("row"), F.col("id").alias("x")).where("row < 150 * 8589934592L")
    folder = by_part(side)
    assert rows_of_part(folder, 77).column("x").to_pylist() == [77, 277, 477, 677, 877] and rows_of_part(folder, 149).num_rows == 5
    assert rows_of_part(folder, 150).num_rows == rows_of_part(folder, 9999).num_rows == 0
    frame = spark.range(10)
    assert as_read(frame) is frame and as_read(frame.repartition(3)).count() == 10 and as_read(frame.groupBy().count()).first()[0] == 10


def test_documents_stay_where_they_are(spark, tmp_path):
    """One document of each group is kept in place, by files, by an exchange, and when the result is dealt anew; no text is shuffled."""
    rows = [(i % 50 if i % 7 else None, f"text number {i % 40} of some words that are its own {i % 40}", i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(9).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = simhash.drop_near_duplicates(docs)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString() and kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) + r["text"] for r in kept.collect())
    groups = {r["root"] for r in simhash.simhash_groups(docs).collect()}
    assert len(ids) == len(groups)
    for same in (simhash.drop_near_duplicates(docs.repartition(5, "n")), simhash.drop_near_duplicates(docs).coalesce(2), simhash.drop_near_duplicates(docs.union(docs))):
        assert sorted(str(r["doc_id"]) + r["text"] for r in same.collect()) == ids
