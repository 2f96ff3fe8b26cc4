"""Sentence boundaries learned from a corpus, and the tokens they give."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexora.functions.treebank import treebank_tokens
from lexora.operators import sentences as S

WORDS = "river town people night road letter winter bread stone window garden water market summer silver morning evening north harvest silent golden little broken simple hidden yellow behind under across between".split()
SHORT = ["Mr. Jones met Dr. Brown in the {}.", "He paid approx. nine coins to Mr. Brown for {0}, cheese, etc. and {0}.", "Dr. Smith and Mr. Smith agreed with Mrs. Jones on approx. half of the {}."]


def plain(rng):
    """A sentence of words that may stand anywhere, so that none always ends one."""
    w = rng.choices(WORDS, k=rng.randint(5, 9))
    return " ".join([w[0].capitalize(), *w[1:]]) + rng.choice("...!?")


def texts(n=200):
    rng = random.Random(5)
    return [" ".join(plain(rng) for _ in range(4)) for _ in range(n)] + [SHORT[i % 3].format(rng.choice(WORDS)) for i in range(n // 2)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (902, "...")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def model(corpus):
    return S.learn_sentences(corpus)


def test_abbreviations_are_learned(model):
    short = {r["type"] for r in model.abbreviations.collect()}
    assert {"mr", "dr", "mrs", "approx", "etc"} <= short
    assert not short & {*WORDS, "jones", "brown"}


def test_score_by_definition(spark):
    """By hand: five tokens of 'dr', all with a full stop, of twenty tokens with eight of these."""
    text = " ".join(["Dr. a"] * 5 + ["end."] * 3 + ["b"] * 7)
    got = S.abbreviation_scores(S.token_counts(spark.createDataFrame([(text,)], "text string"))).where("type = 'dr'").first()
    by_chance, if_short = 5 * math.log(8 / 20), 5 * math.log(0.99)
    assert (got["n_with"], got["n_without"]) == (5, 0) and abs(got["score"] - 2 * (if_short - by_chance) * math.exp(-2)) < 1e-9


def tokens(spark, text, marked):
    return spark.createDataFrame([(text,)], "text string").select(treebank_tokens(F.col("text"), marked)).first()[0]


def test_marks_and_tokens(spark, model):
    mark = lambda text: S.mark_sentences(text, model.sets)
    got = tokens(spark, "Mr. Brown paid approx. ten coins. He left. Really? yes!", mark)
    assert got == ["Mr.", "Brown", "paid", "approx.", "ten", "coins", ".", "He", "left", ".", "Really", "?", "yes", "!"]
    # the fixed list does not know this abbreviation before a capital
    assert "approx." in tokens(spark, "They met approx. Monday noon.", mark) and "approx." not in tokens(spark, "They met approx. Monday noon.", None)
    assert tokens(spark, None, mark) == [] and tokens(spark, "  ", mark) == [] and tokens(spark, "one. ", mark) == ["one", "."]


def test_a_starter_ends_a_sentence_after_an_abbreviation(spark):
    """'The' opens so many sentences that it does so after an abbreviation too; a name does not."""
    rng = random.Random(6)
    rows = [(" ".join("The " + plain(rng).lower() for _ in range(3)) + " Then comes rain, etc. and fog.",) for _ in range(60)] + [("We saw prof. Adams etc. and left.",)] * 30 + [("Bring rope, etc. The rest is here.", ), ("Bring prof. Adams here.",)]
    docs = spark.createDataFrame(rows, "text string")
    model = S.learn_sentences(docs)
    assert "the" in {r["type"] for r in model.starters.collect()}
    said = {(r["before"], r["type"]): r["is_break"] for r in model.decisions.collect()}
    assert said["etc", "the"] and not said["prof", "adams"] and not said["etc", "and"]


def test_sets_and_joins_agree(spark, corpus, model):
    """The marks that the sets give are the boundaries that the joins give."""
    n = corpus.select("doc_id", F.size(F.filter(F.split(S.mark_sentences(F.coalesce("text", F.lit("")), model.sets), "\n"), lambda x: x != "")).alias("n"))
    joined = S.boundaries(corpus, model).where("is_break").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    off = n.where("n > 0 and doc_id < 900").join(joined, "doc_id", "left").where(F.col("n") != F.coalesce("k", F.lit(0)) + 1)
    assert off.count() == 0


def test_large_models_travel_by_join_alone(corpus, model):
    """Without sets the same texts are marked by joins, repeated rows and nulls too."""
    large = S.learn_sentences(corpus, limit=2)
    assert large.sets is None
    more = corpus.union(corpus.where("doc_id < 3")).withColumn("before", F.lit(1))
    marked = lambda m: sorted(map(str, S.marked_texts(more, m).select("doc_id", "text", "before").collect()))
    assert marked(large) == marked(model)


def test_the_engine_with_learned_sentences(spark, corpus, tmp_path):
    """An index of learned sentences keeps an abbreviation's full stop before a capital, and its search cuts queries alike."""
    from lexora.plans.engine import build_index, search

    docs = corpus.union(spark.createDataFrame([(1000, "See approx. Monday noon"), (1001, "Or approx. Friday night")], "doc_id long, text string"))
    index = build_index(docs, stem=False, learn_sentences=True)
    assert index.sentences is not None and index.vocabulary.where("term = 'approx.'").count() == 0 and index.vocabulary.where("term = 'approx'").count() == 1
    found = search(index, spark.createDataFrame([(1, "approx. Monday")], "query_num long, text string"), 3, correction=False).collect()
    assert found


def test_no_texts(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = S.learn_sentences(docs)
    assert model.sets == {"short": [], "odd": []} and S.boundaries(docs, model).count() == 0
    assert docs.select(S.mark_sentences(F.col("text"), model.sets)).count() == 0


def test_texts_are_cut_once_a_pass(spark, corpus, model, monkeypatch):
    """Neither counting nor telling boundaries cuts a text twice, and only what may end a sentence meets the decisions."""
    seen = []
    monkeypatch.setattr(S, "written", lambda df, kept=S.written: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    told = S.boundaries(corpus, model)
    cuts = [p.count("regexp_extract_all") for p in (*seen, told._jdf.queryExecution().optimizedPlan().toString())]
    assert cuts == [1, 0]
    counted = S.token_counts(corpus)._jdf.queryExecution().optimizedPlan().toString()
    # tokens are counted as written before any pattern of types meets them
    assert counted.count("Aggregate [") == 2 and "Aggregate [tok#" in counted


@pytest.mark.parametrize("token", ["Mr.", "1,200.", "3.5", "-7", "...", "!", "A.", "É.", "x-1.", "12", "½.", "a", ",", "٣."])
def test_types(spark, token):
    import unicodedata

    first, plainly = unicodedata.category(token[0]), token
    word = first.startswith("L") or first == "Nd"
    if word and token.endswith("."):
        plainly = token[:-1]
    number = word and all(c in ".,-" or unicodedata.category(c) == "Nd" for c in plainly)
    got = spark.createDataFrame([(token,)], "t string").select(S.token_type(F.col("t"))).first()[0]
    assert got == ("#" if number else plainly.lower())
