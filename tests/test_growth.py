"""Indexes that grow, versions that are whole, spellings from saved deletions, search in the latent space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexora.functions import rules as R
from lexora.operators import correct, rank
from lexora.plans import engine, lsi, storage
from lexora.streaming import append

SIMPLE = {"tokenizer": lambda text: R.simple_tokens(text, "[A-Za-z]+|[0-9]+", lower=False), "stop": []}
DOCS = [
    (1, "Green River runs by green fields 12"), (2, "GREEN river Blue Lake"), (3, "Blue Lake and blue sky 7"), (4, None), (5, ""), (6, "sky SKY Sky"), (7, "Rare Entity once"),
    (8, "Quiet Town by Green River"), (9, "lake"), (2, "more of two"), (None, "no id"), (10, "TOWN hall"), (11, "hall of Quiet Town"),
]


def rows(df):
    return sorted(map(str, df.collect()))


def tables(ix):
    return [rows(t.select(sorted(t.columns))) for t in (ix.vocabulary, ix.postings, ix.doc_stats, ix.stats)]


@pytest.mark.parametrize("cuts", [[0, 13], [0, 1, 2, 13], [0, 4, 4, 9, 13], [0, 6, 13]])
def test_any_split_gives_the_whole_index(spark, tmp_path, cuts):
    """However documents fall into batches, empty ones too, compacted or not, and one repeated."""
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    want = tables(engine.build_index(frame(DOCS), stem=True, **SIMPLE))
    path = f"{tmp_path}/g"
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        append.write_batch(frame(DOCS[a:b]), k, path, **SIMPLE)
    append.write_batch(frame(DOCS[cuts[-2] :]), len(cuts) - 2, path, **SIMPLE)
    assert tables(append.read_index(spark, path)) == want
    before = storage.manifest(spark, path)[0]
    append.compact(spark, path)
    assert len(storage.manifest(spark, path)[1]["base"]) == 1 and not storage.manifest(spark, path)[1]["batches"]
    append.write_batch(frame(DOCS[:1]), 0, path, **SIMPLE)  # a repeated batch that was compacted
    assert tables(append.read_index(spark, path)) == want == tables(append.read_index(spark, path, version=before))
    with pytest.raises(FileNotFoundError):
        append.read_index(spark, f"{tmp_path}/none")


def test_versions_are_whole(spark, tmp_path, monkeypatch):
    """A save that dies between two tables leaves the old index; a reader keeps the version it opened."""
    frame = spark.createDataFrame([(i, f"apple pear w{i % 3}") for i in range(9)], "doc_id long, text string")
    other = spark.createDataFrame([(i, f"plum fig w{i % 3}") for i in range(9)], "doc_id long, text string")
    path = f"{tmp_path}/x"
    assert storage.save(engine.build_index(frame, stem=False, **SIMPLE), path) == 1
    opened = storage.load(spark, path)
    was = tables(opened)
    new = engine.build_index(other, stem=False, **SIMPLE)
    broken = storage.Index(new.vocabulary, new.postings, new.doc_stats.withColumn("doc_length", F.raise_error(F.lit("lost"))), new.stats)
    with pytest.raises(Exception, match="lost"):
        storage.save(broken, path)
    assert tables(storage.load(spark, path)) == was
    system, folder = storage._path(spark, f"{path}/manifests/7.json")
    out = system.create(folder, False)
    out.write(bytearray(b'{"tables": {"index": "v-half'))  # cut off in writing
    out.close()
    assert tables(storage.load(spark, path)) == was
    assert storage.save(new, path) > 1
    assert {r["term"] for r in storage.load(spark, path).vocabulary.collect()} == {"plum", "fig", "w", "0", "1", "2"}
    assert tables(opened) == was == tables(storage.load(spark, path, 1))
    with pytest.raises(FileNotFoundError):
        storage.load(spark, path, 99)


def test_two_writers(spark, tmp_path):
    """A writer that saw an older manifest does not replace a newer one; unnamed tables can be cleared."""
    path = f"{tmp_path}/w"
    frame = spark.createDataFrame([(i, "apple pear") for i in range(3)], "doc_id long, text string")
    for _ in range(3):
        storage.save(engine.build_index(frame, stem=False, **SIMPLE), path)
    with pytest.raises(FileExistsError):
        storage.commit(spark, path, {}, after=1)
    assert len(storage.vacuum(spark, path, keep=1)) == 2
    assert storage.load(spark, path).vocabulary.count() == 2


def test_saved_deletions_are_looked_up(spark, tmp_path):
    """A filter on the keys reaches the scan, the vocabulary is not shuffled, and the candidates are those of comparing all with all."""
    long = "x" * 90
    words = ["apple", "apples", "maple", "ale", long + "ab" + long, long, "b", "", "ünder", "q" * 63, "r" * 64, "s" * 65]
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, df long")
    asked = ["aple", "appel", "ppale", long + "ba" + long, long[:-1] + "y", "c", "undr", "üdner", "q" * 64, "r" * 63, "s" * 64, "r" * 31 + "t" + "r" * 32, "zzz"]
    unknown = spark.createDataFrame([(w,) for w in asked], "term string")
    correct.deletion_table(vocab).repartitionByRange("d").sortWithinPartitions("d").write.parquet(f"{tmp_path}/d")
    keys = spark.read.parquet(f"{tmp_path}/d")
    got = correct.spell_candidates(unknown, vocab, keys)
    want = correct.spell_candidates(unknown, vocab)
    assert rows(got) == rows(want) == rows(unknown.crossJoin(vocab.withColumnRenamed("term", "candidate")).where(correct.within_one_edit(F.col("term"), F.col("candidate"))).select("term", "candidate", "df"))
    plan = keys.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    scan = next(part for part in plan.split("\n\n") if "Scan parquet" in part and "Location" in part)
    assert "PushedFilters: [In(d" in scan or "In(d, [" in scan
    tree = plan[: plan.index("\n\n")]
    # what is exchanged is what the join has found, not what it reads
    below = tree[tree.index("BroadcastHashJoin") :]
    assert "Exchange" not in below.replace("BroadcastExchange", "").split("BroadcastQueryStage")[0].split("LocalTableScan")[0].split("ExistingRDD")[0]
    kept, correct.LOOKUP_KEYS = correct.LOOKUP_KEYS, 2
    try:
        assert rows(correct.spell_candidates(unknown, vocab, keys)) == rows(want)
    finally:
        correct.LOOKUP_KEYS = kept


def test_search_in_the_latent_space(spark, tmp_path):
    """Against all cosines by numpy, in one group of queries or many; the space and its numbers come back from disk."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ix = engine.build_index(docs, stem=False, **SIMPLE)
    space = lsi.decompose(ix, k=6)
    lsi.save_space(space, ix, f"{tmp_path}/s")
    opened = lsi.load_space(spark, f"{tmp_path}/s")
    assert opened.values == space.values
    numbers = [r["row_id"] for r in opened.docs.collect()]
    assert sorted(numbers) == list(range(len(numbers))) and sorted(r["term_id"] for r in opened.terms.collect()) == list(range(opened.terms.count()))
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id as query_num", "text")
    weights = rank.query_weights(engine.parse_queries(asked, stem=False, **SIMPLE))
    got = sorted((r["query_num"], r["rnk"], r["doc_id"], r["score"]) for r in lsi.search(opened, weights, 5).collect())
    few = sorted((r["query_num"], r["rnk"], r["doc_id"], r["score"]) for r in lsi.search(opened, weights, 5, queries=7).collect())
    vectors = opened.docs.select("doc_id", "v").collect()
    unit = lsi._unit(np.array([r["v"] for r in vectors]))
    want = []
    for r in lsi.fold_in(opened, weights).collect():
        s = np.round(unit @ lsi._unit(np.array([r["v"]]))[0], 9)
        best = sorted(zip(-s, (x["doc_id"] for x in vectors)))[:5]
        want += [(r["query_num"], k, d, -x) for k, (x, d) in enumerate(best, 1)]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=2e-9)
    assert len({x[0::2][:2] for x in got} & {x[0::2][:2] for x in want}) >= 0.99 * len(want)
    assert [x[:3] for x in few] == [x[:3] for x in got]
    assert lsi.search(opened, weights.where("false"), 5).count() == 0
    none = lsi.Space([], space.terms.where("false"), space.docs.where("false"))
    assert lsi.search(none, weights, 5).count() == 0


def test_products_of_the_latent_space_stay_in_blocks(spark, monkeypatch):
    """A document has one row in its block and a term one sum in each: no vector goes with a cell. Against all sums by numpy, also where few terms are broadcast and few cells meet at a time, of an index that tells its frequencies or does not."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 900").select("doc_id", "text").unionAll(spark.createDataFrame([(7, "a the"), (1 << 40, "the")], "doc_id long, text string"))
    built = engine.build_index(docs, stem=False, **SIMPLE)
    bare = storage.Index(built.vocabulary, storage.written(built.postings), built.doc_stats, built.stats)
    cells = lsi._cells(bare, bare.n_docs()).withColumn("h", F.xxhash64("term")).toPandas()
    sign = 1.0 - 2.0 * ((cells["h"].to_numpy()[:, None] >> np.arange(5)) & 1)
    left = {d: (g["x"].to_numpy()[:, None] * sign[g.index]).sum(axis=0) for d, g in cells.groupby("doc_id")}
    whole = lsi.decompose(built, k=3, more=2, rounds=1)
    monkeypatch.setattr(lsi, "TERMS", 60)
    monkeypatch.setattr(lsi, "CELLS", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        for ix in (built, bare):
            coded = lsi._coded(ix, 5)
            table, blocks, n_terms = lsi._blocks(ix, coded, 5)
            rows, names = table.collect(), {r["term_id"]: r["term"] for r in coded.collect()}
            of_docs, of_terms = [r for r in rows if r["doc_id"] is not None], [r for r in rows if r["doc_id"] is None]
            assert blocks > 4 and n_terms == len(names) and len({r["block"] for r in rows}) > 4
            assert len({r["doc_id"] for r in of_docs}) == len(of_docs) and len({(r["block"], r["term_id"]) for r in of_terms}) == len(of_terms)
            assert {r["doc_id"] for r in of_docs if r["some"]} == set(left) and all(np.allclose(r["v"], left[r["doc_id"]], atol=1e-12) for r in of_docs if r["some"])
            assert sorted((r["doc_id"], names[t], x, x / r["max_tf"]) for r in of_docs for t, x in zip(r["ids"], r["tfs"])) == sorted((r["doc_id"], r["term"], r["tf"], r["ntf"]) for r in bare.postings.collect())
            sums = {}
            for r in of_docs:
                for t, x in zip(r["ids"], r["tfs"]):
                    sums[r["block"], t] = sums.get((r["block"], t), 0) + x / r["max_tf"] * np.array(r["v"])
            assert sums.keys() == {(r["block"], r["term_id"]) for r in of_terms} and all(np.allclose(r["v"], sums[r["block"], r["term_id"]], atol=1e-10) for r in of_terms)
            space = lsi.decompose(ix, k=3, more=2, rounds=1)
            assert np.allclose(space.values, whole.values, rtol=1e-9)
            for a, b, key in ((space.docs, whole.docs, "doc_id"), (space.terms, whole.terms, "term")):
                a, b = ({r[key]: np.array(r["v"]) for r in x.collect()} for x in (a, b))
                flip = np.sign(sum(a[x] * b[x] for x in b))
                assert a.keys() == b.keys() and all(np.allclose(a[x] * flip, b[x], atol=1e-8) for x in b)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # few cells at a time
    monkeypatch.setattr(lsi, "AT_ONCE", 7)
    block, rng = lsi._Block(3000, 2), np.random.default_rng(1)
    want = np.zeros((3000, 2))
    for n in (40, 3000):
        t, x, doc, v = rng.integers(0, 3000, n), rng.random(n), rng.integers(0, 9, n), rng.random((9, 2))
        block.add(t, x, doc, v)
        np.add.at(want, t, x[:, None] * v[doc])
    terms = np.concatenate(block.terms)
    assert len(terms) == block.n == len(set(terms)) == (want[:, 0] > 0).sum() and np.allclose(block.sums[: block.n], want[terms])


def test_malformed_query_lines_are_reported(spark, tmp_path, caplog):
    """Lines without a dot are named in a warning; a whole file gives none."""
    from lexora.sources import corpus as S

    (tmp_path / "q.txt").write_text("1.masks\n\nno number here\n2.cnn news. today\nagain none\n")
    (tmp_path / "w.txt").write_text("1.masks\n")
    with caplog.at_level("WARNING", logger="lexora.sources.corpus"):
        assert S.read_queries(spark, f"{tmp_path}/w.txt").count() == 1 and not caplog.records
        assert S.read_queries(spark, f"{tmp_path}/q.txt").count() == 2
    assert "2 malformed lines" in caplog.text and "no number here" in caplog.text


def test_stems_as_expressions(spark):
    """The chain of expressions gives the stems of the scalar algorithm, of a table's words and of awkward ones; other columns stay."""
    from lexora.functions.stem import porter2, stem_vocabulary

    words = """skies dying gently only sky news atlas inning herring proceed exceeding caresses ties cries gas this kiwis agreed feed bled sing luxuriated hopping hoping
    happy enjoy by say conditional rational valenci differently vietnamization predication operator feudalism sensitiviti formaliti radically hopefulness goodness activate
    revival allowance adoption communism effective probate rate cease controll roll generate communal arsenal yyyy ayy youth boyish apologi geologi fluently trouble sized
    knack nationalize triplicate electrical derivative sses ied ies s us ss x ab É élan ISTANBUL groß ing ed ingly eed eedly YES y Yy 12 a1 don't""".split()
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("term")).distinct()
    rows = table.union(spark.createDataFrame([(w,) for w in words], "term string")).withColumns({"w": F.col("term"), "t": F.lit(1), "h": F.lit(2)})
    got = stem_vocabulary(rows).collect()
    assert len(got) > 10_000 and all(r["term"] == (porter2(r["w"]) if r["w"].isalpha() else r["w"]) and (r["t"], r["h"]) == (1, 2) for r in got)


def test_no_python_worker_in_the_index(spark):
    """Stems, tokens and counts of the default engine stay in the JVM."""
    docs = spark.createDataFrame([(1, "Running rivers run."), (2, "The river runs.")], "doc_id long, text string")
    seen = []
    kept = storage.written
    try:
        for module in (storage, __import__("lexora.operators.index", fromlist=["x"])):
            module.written = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df)
        ix = engine.build_index(docs)
    finally:
        storage.written = kept
        __import__("lexora.operators.index", fromlist=["x"]).written = kept
    assert {r["term"] for r in ix.vocabulary.collect()} >= {"run", "river"}
    assert len(seen) >= 4 and not [p for p in seen if "Python" in p or "Arrow" in p or "Pandas" in p]


@pytest.mark.parametrize("hot", [5_000_000, 3])
def test_saved_postings_need_no_join(spark, tmp_path, monkeypatch, hot):
    """Postings are ordered by one exchange of the frequencies; terms of many rows are dealt by document too. What is saved is what postings() gives, in order in each file."""
    from lexora.operators import index

    frame = spark.createDataFrame([(i, f"apple pear w w{i % 3} only{chr(97 + i)}x") for i in range(9)], "doc_id long, text string")
    ix = engine.build_index(frame, stem=False, **SIMPLE)
    want = rows(ix.postings.select("term", "doc_id", "tf", "ntf"))
    made, seen = index.ordered_postings, []
    monkeypatch.setattr(index, "ordered_postings", lambda *a: seen.extend(made(*a, hot)) or seen)
    storage.save(ix, f"{tmp_path}/x")
    assert len(seen) == (2 if hot == 3 else 1)
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange rangepartitioning") == 1 == plan.count("Exchange") and "Join" not in plan
    saved = storage.load(spark, f"{tmp_path}/x").postings
    assert rows(saved.select("term", "doc_id", "tf", "ntf")) == want
    for part in saved.select("term", "doc_id").rdd.glom().collect():
        assert hot == 3 or part == sorted(part)


def test_a_text_alone_is_counted_in_its_row(spark):
    """Documents of one text are folded without an exchange; of several texts, or with URL terms, by one. Both give what dealing all of them gives."""
    from lexora.operators import index, parse

    odd = [(20, "İstanbul istanbul ISTANBUL Straße STRASSE strasse 5K 5k 12 12 sTATUS Status"), (21, "Ab-cd AB ab 1.5K Green River Green River"), (22, "GREEN x"), (23, "Green x 12")]
    texts = spark.createDataFrame([d for d in DOCS if d[0]] + odd, "doc_id long, text string").withColumn("url_terms", F.when(F.col("doc_id") == 22, F.array(F.lit("GREEN"), F.lit("green"))))
    for options in (SIMPLE, {}):
        counts = storage.written(parse.parse_counts(texts, "doc_id", **options))
        forms = index.canonical_forms(counts, False, 2)
        got, want = index.index_frequencies(counts, forms, False), index._dealt_frequencies(counts, forms, False)
        assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns)))
        assert {2, 22} <= {r[0] for r in index.unsure_documents(counts).collect()} < {r[0] for r in counts.select("doc_id").collect()}
        alone = index.index_frequencies(counts.join(index.unsure_documents(counts), "doc_id", "left_anti").localCheckpoint(), forms, False)
        assert "Exchange hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_stemmed_index_are_counted_as_they_stand(spark, monkeypatch):
    """No text's plain words take a form of their own before they meet the vocabulary; the index is that of counts by form."""
    from lexora.operators import index, parse

    odd = [(20, "İstanbul istanbul ISTANBUL Straße STRASSE strasse 5K 5k 12 12 sTATUS Status wEB web Running runs"), (21, "Ab-cd AB ab 1.5K Green River Green River river's"), (22, "GREEN x iPhone I i"), (23, "Green x 12 12 55 million"), (23, "runs Runs RUNS @user #StayHome 12")]
    texts = spark.createDataFrame([d for d in DOCS if d[0]] + odd, "doc_id long, text string").withColumn("url_terms", F.when(F.col("doc_id") == 22, F.array(F.lit("GREEN"), F.lit("green"))))
    counts, by_form = storage.written(parse.parse_forms(texts)), storage.written(parse.parse_counts(texts))
    assert {"t", "w", "e", "u"} == {r["kind"] for r in counts.select("kind").distinct().collect()}
    assert {"Running", "runs", "Runs"} <= {r["form"] for r in counts.where("kind = 't'").collect()}
    got, want = (index.index_frequencies(c, index.canonical_forms(c, True, 2), True) for c in (counts, by_form))
    assert rows(got.select(sorted(got.columns))) == rows(want.select(sorted(want.columns))) and got.count() > 20
    monkeypatch.setattr(parse, "parse_counts", None)
    assert {r["term"] for r in engine.build_index(texts).vocabulary.collect()} >= {"run", "x"}
