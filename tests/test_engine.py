import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexora.functions.rules import simple_tokens
from lexora.operators import correct, index, joins, parse, rank
from lexora.plans import engine, lsi, storage
from lexora.sources import corpus as S
from lexora.sources.schemas import POST_FIELDS
from lexora.streaming.append import append_postings, read_postings

SIMPLE = {"tokenizer": lambda c: simple_tokens(c), "stop": []}


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_frequencies(spark):
    d = docs(spark, [(1, "a b a a c a b"), (2, None), (3, "")])
    f = {(r["doc_id"], r["term"]): r for r in index.term_frequencies(d, simple_tokens(F.col("text")), positions=True).collect()}
    assert f[1, "a"]["tf"] == 4 and f[1, "b"]["ntf"] == 0.5 and f[1, "a"]["positions"] == [0, 2, 3, 5] and len(f) == 3
    g = {(r["doc_id"], r["term"]): r for r in index.term_frequencies(d, simple_tokens(F.col("text"))).collect()}
    assert {k: (r["tf"], r["max_tf"], r["ntf"]) for k, r in g.items()} == {k: (r["tf"], r["max_tf"], r["ntf"]) for k, r in f.items()}


def test_frequencies_of_rows_that_share_a_key(spark):
    got = index.term_frequencies(docs(spark, [(1, "a b a"), (1, "b c"), (2, "c")]), simple_tokens(F.col("text"))).collect()
    assert sorted((r["doc_id"], r["term"], r["tf"], r["max_tf"]) for r in got) == [(1, "a", 2, 2), (1, "b", 2, 2), (1, "c", 1, 2), (2, "c", 1, 1)]


def test_counts_shuffle_nothing(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for counted in (index.term_frequencies(d, simple_tokens(F.col("text"))), parse.parse_counts(d)):
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and plan.count("Exchange") <= 1  # a small table is spread over the cores


def test_only_small_tables_are_spread(spark):
    small, large = spark.range(10), spark.range(1 << 40)
    assert "RoundRobinPartitioning" in storage.spread(small)._jdf.queryExecution().executedPlan().toString()
    assert storage.spread(large) is large


AWKWARD = [(1, "The quick-witted Fox saw Barack Obama in New York City, 10:30 at 3.14! Obama's $5,000 and 6 percent"), (2, None), (3, ""), (4, "@user said #StayAtHome2020 either/or RT web status"), (5, "NASA nasa Nasa " * 50 + "don't can't I'm"), (6, "#"), (7, "x" * 5000 + " état d'été – 日本 🙂")]


@pytest.mark.parametrize("stop", [None, []])
def test_counts_agree_with_occurrences(spark, stop):
    """What parse() gives an occurrence a row, parse_counts() gives counted."""
    more = {} if stop is None else {"stop": stop}
    d = docs(spark, AWKWARD).unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text")).withColumn("url_terms", F.when(F.col("doc_id") < 3, F.array(F.lit("CNN"), F.lit("x"))))
    want = parse.parse(d, stem=False, **more).groupBy("doc_id", "term", "is_entity").agg(F.count(F.lit(1)).alias("tf"), F.count_if("is_number").alias("numbers"))
    got = parse.parse_counts(d, **more).groupBy("doc_id", F.col("form").alias("term"), (F.col("kind") == "e").alias("is_entity")).agg(F.sum("tf").alias("tf"), F.sum("numbers").alias("numbers"))
    a, b = (sorted(map(tuple, x.collect()), key=repr) for x in (want, got))
    assert a == b and len(a) > 1000
    lengths = {r[0]: r[1] for r in parse.parse_lengths(d, **more).collect()}
    assert all(lengths[r[0]] == r[1] for r in parse.parse_counts(d, **more).select("doc_id", "doc_length").distinct().collect())


def test_stop_words_are_those_given(spark):
    terms = lambda **k: [r["term"] for r in parse.parse(docs(spark, [(1, "don't")]), stem=False, **k).collect()]
    assert terms() == [] and terms(stop=[]) == ["do", "n't"]


@pytest.mark.parametrize("limit", [0, 1, 3, 100])
def test_join_terms(spark, limit):
    rows = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 1), ("c", 2), ("c", 3), ("zz" * 200, 4), ("gone", 5), (None, 6)], "term string, x int")
    vocab = spark.createDataFrame([("a", 30, 1), ("b", 1, 2), ("c", 2, 3), ("zz" * 200, 99, 4), ("other", 7, 5)], "term string, n long, y int")
    got = joins.join_terms(rows, vocab, ["term"], "n", limit)
    assert got.columns == ["term", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(vocab.drop("n"), "term").collect()))


def test_hapax_and_lengths(spark):
    ix = engine.build_index(docs(spark, [(1, "apple pear"), (2, "apple plum"), (3, "")]), stem=False)
    assert {r["term"]: r["df"] for r in ix.vocabulary.collect()} == {"apple": 2}
    assert ix.n_docs() == 3 and {r["doc_id"] for r in ix.doc_stats.collect()} == {1, 2}


def test_cosine_example(spark):
    postings = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 0.5)], "term string, doc_id long, ntf double")
    vocab = spark.createDataFrame([("a", 5), ("b", 2)], "term string, df long")
    asked = rank.query_weights(spark.createDataFrame([(1, "a"), (1, "b")], "query_num long, term string"))
    assert rank.cosine_scores(asked, postings, vocab, 10).first()["score"] == 0.997237
    one = rank.query_weights(spark.createDataFrame([(1, "a")], "query_num long, term string"))
    assert rank.cosine_scores(one, postings, vocab, 10).first()["score"] == 1.0
    assert rank.cosine_scores(one, postings, vocab, 5).first()["score"] == 0.0


@pytest.mark.parametrize("k, want", [(0, 0), (3, 3), (5000, 2000), (-1, 2000)])
def test_top(spark, k, want):
    scores = spark.range(2500).select(F.lit(1).alias("query_num"), F.col("id").alias("doc_id"), F.lit(0.5).alias("score"))
    got = rank.top_results(scores, k).orderBy("rnk").collect()
    assert len(got) == want and [r["doc_id"] for r in got[:3]] == list(range(min(3, want)))


def test_newer_first(spark):
    scores = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5)], "query_num long, doc_id long, score double")
    dates = spark.sql("select 1L as doc_id, timestamp'2020-01-01' as created_at union all select 2L, timestamp'2021-01-01'")
    assert [r["doc_id"] for r in rank.top_results(scores, 9, dates).orderBy("rnk").collect()] == [2, 1, 3]


def test_corrections(spark):
    vocab = spark.createDataFrame([("the", 9), ("ten", 4), ("covid", 3), ("tie", 9)], "term string, df long")
    asked = spark.createDataFrame([(1, "teh"), (1, "COVID"), (1, "zzzzz")], "query_num long, term string")
    assert sorted(r["term"] for r in correct.correct_queries(asked, vocab).collect()) == ["covid", "the", "zzzzz"]


def test_fold_case_adds_up(spark):
    ix = engine.build_index(docs(spark, [(1, "NASA nasa"), (2, "NASA"), (2, "UNO NASA"), (3, "UNO")]), **SIMPLE | {"stem": False, "tokenizer": lambda c: simple_tokens(c, "[A-Za-z]+", False)})
    assert sorted(tuple(r) for r in ix.postings.select("term", "doc_id", "tf").collect()) == [("UNO", 2, 1), ("UNO", 3, 1), ("nasa", 1, 2), ("nasa", 2, 2)]
    t = spark.createDataFrame([("NASA",), ("nasa",), ("UNO",)], "term string")
    assert sorted(tuple(r) for r in index.fold_case(t).collect()) == [("NASA", "nasa"), ("UNO", "UNO"), ("nasa", "nasa")]


def test_ordinals(spark):
    t = spark.createDataFrame([(w,) for w in "d b a c b a".split()], "term string")
    assert {r["term"]: r["id"] for r in index.ordinals(t, "term").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_results_do_not_depend_on_partitions(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    q = spark.createDataFrame([(1, "the idiot of"), (2, "worthless clown")], "query_num long, text string")
    one, many = (sorted(map(tuple, engine.search(engine.build_index(x, **SIMPLE), q, 5, **SIMPLE).collect())) for x in (d.coalesce(1), d.repartition(7)))
    assert one == many and len(one) == 10 and all(0 <= r[2] <= 1.000001 for r in one)


def test_run_end_to_end(spark, tmp_path):
    base = dict.fromkeys(POST_FIELDS)
    posts = [
        base | {"post_id": "1", "created": "Wed Jul 22 12:20:42 +0000 2020", "full_text": "Masks save lives says Doctor", "urls": "{}"},
        base | {"post_id": "2", "created": "Thu Jul 23 12:20:42 +0000 2020", "full_text": "masks again", "urls": '{"https://t.co/a":"https://www.cnn.com/b"}'},
        base | {"post_id": "3", "created": "bad", "full_text": "nothing on masks", "urls": None, "quoted_text": "see cnn"},
    ]
    (tmp_path / "in/deep").mkdir(parents=True)
    pd.DataFrame(posts).astype("string").to_parquet(tmp_path / "in/deep/x.parquet")
    (tmp_path / "in/readme.txt").write_text("not a post")
    (tmp_path / "queries.txt").write_text("1.masks\n\nno number here\n2.cnn news. today\n")
    got = engine.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/queries.txt", 10)
    rows = sorted((r["query_num"], r["rnk"], r["doc_id"], r["score"]) for r in got.collect())
    assert [r[2] for r in rows if r[0] == 2] == [2, 3]
    assert {r[3] for r in rows if r[0] == 1} == {0.0}  # a term of every document weighs nothing
    assert [r[2] for r in rows if r[0] == 1] == [2, 1, 3]  # newer first, unknown dates last
    csv = spark.read.option("header", True).csv(f"{tmp_path}/out/results")
    assert csv.columns == ["Query_num", "Tweet_id", "Rank"] and csv.count() == len(rows)


def test_empty_corpus(spark, tmp_path):
    (tmp_path / "none").mkdir()
    posts = S.read_corpus(spark, f"{tmp_path}/none")
    ix = engine.build_index(S.posts_to_corpus(posts))
    assert engine.search(ix, S.query_list(spark, ["anything", ""]), 5).count() == 0


def test_saved_index_is_pruned_by_terms(spark, tmp_path):
    ix = engine.build_index(docs(spark, [(i, f"common w{i % 3}") for i in range(30)]), **SIMPLE)
    storage.save(ix, f"{tmp_path}/ix")
    back = storage.load(spark, f"{tmp_path}/ix")
    assert sorted(map(tuple, back.vocabulary.collect())) == sorted(map(tuple, ix.vocabulary.collect()))
    hit = storage.lookup(back, spark.createDataFrame([("common",)], "term string"))
    assert hit.count() == 30
    assert "PushedFilters" in hit._jdf.queryExecution().toString() and "common" in hit._jdf.queryExecution().toString()


def test_growing_index(spark, tmp_path):
    docs(spark, [(1, "apple pear"), (2, "apple plum")]).write.parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/a")
    append_postings(stream, f"{tmp_path}/p", f"{tmp_path}/c", stem=False).awaitTermination()
    docs(spark, [(3, "plum pie")]).write.mode("append").parquet(f"{tmp_path}/a")
    append_postings(stream, f"{tmp_path}/p", f"{tmp_path}/c", stem=False).awaitTermination()
    vocab, postings = read_postings(spark, f"{tmp_path}/p")
    assert {r["term"]: r["df"] for r in vocab.collect()} == {"apple": 2, "plum": 2} and postings.count() == 4


def test_one_file(spark, tmp_path):
    """A single file by its absolute path, or by its name below the root."""
    posts = [dict.fromkeys(POST_FIELDS) | {"post_id": str(i), "created": "Wed Jul 22 12:20:42 +0000 2020", "full_text": f"text {i}"} for i in range(3)]
    (tmp_path / "deep").mkdir()
    pd.DataFrame(posts[:2]).astype("string").to_parquet(tmp_path / "deep/a.parquet")
    pd.DataFrame(posts[2:]).astype("string").to_parquet(tmp_path / "b.parquet")
    assert [r["post_id"] for r in S.read_file(spark, str(tmp_path), "b.parquet").collect()] == ["2"]
    assert sorted(r["post_id"] for r in S.read_file(spark, "elsewhere", f"{tmp_path}/deep/a.parquet").collect()) == ["0", "1"]


def test_query_urls(spark):
    """A query's own URLs give their domains, as often as they stand there; a document's come with it."""
    q = spark.createDataFrame([(1, "see https://www.cnn.com/a and http://www.cnn.com/b or https://t.co/x"), (2, "no address"), (3, None)], "query_num long, text string")
    got = parse.parse(q, "query_num", stem=False, queries=True).where("pos is null").collect()
    assert sorted((r["query_num"], r["term"]) for r in got) == [(1, "cnn"), (1, "cnn")]
    assert parse.parse(q, "query_num", stem=False).where("pos is null").count() == 0
    terms = engine.parse_queries(q, stem=False).where("query_num = 1 and term = 'cnn'").count()
    assert terms >= 2


def test_figures_of_a_build(spark, tmp_path):
    ix = engine.build_index(docs(spark, [(1, "apple pear"), (2, "apple plum"), (3, "pear"), (4, "")]), **SIMPLE)
    figures = engine.save_measured(ix, f"{tmp_path}/ix")
    assert {k: figures[k] for k in ("terms", "postings", "documents")} == {"terms": 2, "postings": 4, "documents": 3} and figures["merge_seconds"] >= 0


def test_intermediate_tables_lie_below_the_shared_folder(spark):
    t = storage.written(spark.range(3))
    assert all(f.startswith(("file:///tmp/", "file:/tmp/")) for f in t.inputFiles()) and t.count() == 3
    folder = storage.new_folder(spark)
    spark.range(2).write.mode("overwrite").parquet(folder)
    storage.delete(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(unset)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "hdfs://x/y/"), sparkContext=unset.sparkContext)
    assert storage.shared_root(named) == "hdfs://x/y"


def test_options_reach_the_parser(spark, tmp_path):
    base = dict.fromkeys(POST_FIELDS) | {"created": "Wed Jul 22 12:20:42 +0000 2020", "urls": "{}"}
    posts = [base | {"post_id": str(i), "full_text": "we # StayHome", "retweet_text": "repeated words"} for i in (1, 2)]
    (tmp_path / "in").mkdir()
    pd.DataFrame(posts).astype("string").to_parquet(tmp_path / "in/x.parquet")
    terms = lambda out: {r["term"] for r in storage.load(spark, f"{tmp_path}/{out}/without_stem").vocabulary.collect()}
    engine.run(spark, f"{tmp_path}/in", f"{tmp_path}/a", ["home"], 5, stem=False)
    engine.run(spark, f"{tmp_path}/in", f"{tmp_path}/b", ["home"], 5, stem=False, keep_full_tag=True, include_retweet_text=True)
    assert terms("a") == {"stay", "home"} and terms("b") == {"stay", "home", "#stayhome", "repeated", "words"}


def test_singular_values_of_the_index(spark):
    """Values and vectors are those of the whole matrix's decomposition."""
    import numpy as np

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 900").select("doc_id", "text")
    ix = engine.build_index(d, **SIMPLE)
    terms, rows = (r.toPandas() for r in lsi.id_tables(ix))
    cells = lsi._cells(ix, ix.n_docs()).toPandas().merge(terms, on="term").merge(rows, on="doc_id")
    assert sorted(terms["term_id"]) == list(range(len(terms))) and sorted(rows["row_id"]) == list(range(len(rows)))
    a = np.zeros((len(rows), len(terms)))
    a[cells["row_id"], cells["term_id"]] = cells["x"]
    space = lsi.decompose(ix, k=4, more=12, rounds=3)
    assert np.allclose(space.values, np.linalg.svd(a, compute_uv=False)[:4], rtol=0.02)
    v, u = np.zeros((len(terms), 4)), np.zeros((len(rows), 4))
    for t, i in zip((space.terms.toPandas().merge(terms, on="term"), space.docs.toPandas().merge(rows, on="doc_id")), ("term_id", "row_id")):
        (v if i == "term_id" else u)[t[i]] = np.stack(t["v"])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-6) and np.allclose(u.T @ u, np.eye(4), atol=1e-6)
    assert np.allclose(np.diag(u.T @ a @ v), space.values, rtol=1e-6)
    # a document asked as a query lies where the document lies
    one = cells[cells["row_id"] == 3]
    asked = spark.createDataFrame([(1, t, float(x)) for t, x in zip(one["term"], one["x"])], "query_num long, term string, w double")
    assert np.allclose(lsi.fold_in(space, asked).first()["v"], a[3] @ v / space.values, atol=1e-9)
    empty = lsi.decompose(engine.build_index(d.limit(0), **SIMPLE))
    assert empty.values == [] and empty.terms.count() == 0




def test_positions_travel_with_their_term_alone(spark):
    """A text's words are not copied for each of its terms: work grows with the text, not its square."""
    docs = spark.createDataFrame([(1, "b a b a c")], "doc_id long, text string")
    freq = index.term_frequencies(docs, simple_tokens(F.col("text")), positions=True)
    assert {r["term"]: r["positions"] for r in freq.collect()} == {"a": [1, 3], "b": [0, 2], "c": [4]}
    plan = freq._jdf.queryExecution().executedPlan().toString()
    kept = re.findall(r"Generate explode\(r#\d+\), \[([^\]]*)\]", plan)
    assert kept and all(re.sub(r"#\d+L?", "", k).split(", ") == ["doc_id", "max_tf"] for k in kept)


def test_terms_are_made_inside_the_row(spark):
    """No rule is left to exploded rows, where all of them together were too long a method to be compiled."""
    docs = spark.createDataFrame([(1, "The 5 Big Cats met I wEB 12/5 x/yz a-b")], "doc_id long, text string")
    plan = parse.parse(docs, stem=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "RLIKE" not in plan[: plan.index("Generate")]


def test_forms_that_cannot_change_meet_no_vocabulary(spark):
    counts = spark.createDataFrame([(1, "big", "w", 2, 0, 5), (1, "BIG", "w", 1, 0, 5), (2, "BIG", "w", 1, 0, 1), (2, "Big Cat", "e", 1, 0, 1), (3, "USA", "w", 1, 0, 1)], "doc_id long, form string, kind string, tf long, numbers long, doc_length int")
    forms = index.canonical_forms(counts, False, 2)
    both = [{(r["doc_id"], r["term"], r["tf"]) for r in index.index_frequencies(counts, f, False).collect()} for f in (forms, forms.where("form <> 'big'"))]
    assert both == [{(1, "big", 3), (2, "big", 1), (3, "USA", 1)}] * 2


def test_dates_do_not_shuffle_texts(spark):
    from lexora import queries

    texts = queries._corpus(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    assert "Join" not in texts._jdf.queryExecution().optimizedPlan().toString()


def test_scores_shuffle_postings_and_not_pairs(spark):
    """However many queries ask for a term, a posting is shuffled once; the scores are those of the plain sums."""
    import math

    postings = spark.createDataFrame([(t, d, 1.0 / (1 + (d + k) % 3)) for k, t in enumerate("abc") for d in range(0, 60, k + 1)], "term string, doc_id long, ntf double")
    vocab = postings.groupBy("term").count().withColumnRenamed("count", "df")
    asked = spark.createDataFrame([(q, t) for q in range(40) for t in ("ab", "bc", "abc", "aab")[q % 4]], "query_num long, term string")
    weights = rank.query_weights(asked)
    scores = rank.cosine_scores(weights, storage.written(postings), storage.written(vocab), 100)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if re.search(r"\bExchange\b", line)]
    assert len([line for line in dealt if "doc_id" in line]) == 1 and not [line for line in dealt if "query_num" in line]  # the terms' own exchange is small
    df = {r["term"]: r["df"] for r in vocab.collect()}
    lists, want = {}, {}
    for r in postings.collect():
        lists.setdefault(r["term"], []).append((r["doc_id"], math.log10(100 / df[r["term"]]) * r["ntf"]))
    for w in weights.collect():
        for d, x in lists[w["term"]]:
            dot, norm, _ = want.get((w["query_num"], d), (0, 0, 0))
            want[w["query_num"], d] = dot + w["w"] * x, norm + x * x, w["q_norm"]
    got = {(r["query_num"], r["doc_id"]): r["score"] for r in scores.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - dot / math.sqrt(norm) / q) < 2e-6 for k, (dot, norm, q) in want.items())


@pytest.mark.parametrize("repeat", [False, True])
def test_folded_vocabulary_is_of_one_exchange(spark, repeat):
    """As folding all (document, term) rows, which are not shuffled now; rows that share a key are one document."""
    rows = [(1, "NASA nasa Nasa nAsA the The THE"), (2, "NASA Uno"), (3, "UNO then thE nasas"), (4, None), (5, ""), (6, "b B Bb bB a")] + [(2, "nasa Uno b")] * repeat
    d = docs(spark, rows)
    tokens = simple_tokens(F.col("text"), "[A-Za-z]+", False)
    got = index.folded_vocabulary(d, tokens)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == repeat and plan.count("Exchange hashpartitioning") == 1 + repeat
    from lexora.functions.rules import capital_form

    forms = index.term_frequencies(d, F.transform(tokens, capital_form))
    folds = index.fold_case(forms.select("term").distinct())
    want = forms.join(folds, "term").groupBy("doc_id", "folded").agg(F.sum("tf").alias("tf")).groupBy(F.col("folded").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("term", "df", "tf").collect()))


def test_merged_vocabulary_counts_a_document_once(spark, monkeypatch):
    """Only rows of terms that share a name meet the names."""
    freq = storage.written(spark.createDataFrame([(1, "river"), (1, "rivers"), (2, "rivers"), (3, "sky"), (4, "sky"), (5, "once")], "doc_id long, term string"))
    names = storage.written(index.vocabulary(freq).withColumn("stem", F.when(F.col("term") == "rivers", "river").otherwise(F.col("term"))))
    met = []
    monkeypatch.setattr(index, "join_terms", lambda rows, vocab, *a, **k: met.append(sorted(r["term"] for r in vocab.collect())) or joins.join_terms(rows, vocab, *a, **k))
    assert sorted(map(tuple, index.merged_vocabulary(freq, names, "stem", 2).collect())) == [("river", 2), ("sky", 2)]
    assert met == [["river", "rivers"]]
