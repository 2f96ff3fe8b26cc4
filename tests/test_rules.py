import re

import pytest
from pyspark.sql import functions as F

from lexora.functions import rules as R
from lexora.functions import urls as U
from lexora.functions.dates import age_minutes, post_time
from lexora.functions.stem import porter2
from lexora.functions.treebank import treebank_tokens
from lexora.operators import parse


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "before, number, after, want",
    [
        (None, "999", None, "999"), (None, "1000", None, "1.0K"), (None, "1,234,567", None, "1.235M"), (None, "55", "million", "55M"),
        (None, "2500", "million", "2.5B"), (None, "10", "thousand", "10K"), (None, "3", "billion", "3B"), (None, "6", "%", "6%"),
        (None, "6", "percent", "6%"), ("usd", "20", None, "$20"), (None, "5000", "percent", "5000%"), (None, ".5", None, "0.5"),
        (None, "10:30", None, "1.03K"), (None, "1000000", None, "1.0M"), (None, "1000000000", None, "1.0B"), (None, "-5", None, "-5"),
    ],
)
def test_numbers(spark, before, number, after, want):
    df = spark.createDataFrame([(before, number, after)], "b string, n string, a string")
    assert df.select(R.number_terms(F.col("n"), F.col("b"), F.col("a"))).first()[0] == [want]


@pytest.mark.parametrize("number", ["9876543210123456789012345678", "12345678901234567890123", "9007199254740993123456789", "80000000000001900000007", "9" * 60, "1" + "0" * 300, "1099511627776000500000"])
def test_long_numbers_have_all_their_digits(spark, number):
    """A double's shortest digits are not enough: all of its places are printed, as by printf."""
    want = re.sub(r"(\.\d*?[1-9]|\.0)0+$", r"\1", f"{float(number) / 1e9:.3f}") + "B"
    df = spark.createDataFrame([(number,)], "n string")
    assert df.select(R.number_terms(F.col("n"), F.lit(""), F.lit(""))).first()[0] == [want]


@pytest.mark.parametrize("tag, want", [("stay_at_home", ["stay", "at", "home"]), ("StayAtHome2020", ["stay", "at", "home", "2020"]), ("COVID19", ["covid", "19"])])
def test_hashtags(spark, tag, want):
    assert one(spark, R.split_hashtag(F.col("t")), t=tag) == want
    assert one(spark, R.split_hashtag(F.col("t"), keep_full_tag=True), t=tag) == ["#" + tag.lower(), *want]


@pytest.mark.parametrize("token, want", [("covid-19", ["covid", "19"]), ("Covid-", ["covid"]), ("555-3824", ["555-3824"])])
def test_hyphens(spark, token, want):
    assert one(spark, R.split_hyphen(F.col("t")), t=token) == want


@pytest.mark.parametrize("token, want", [("either/or/x", ["either", "or"]), ("//www.cnn.com/abc", ["www.cnn.com", "abc"]), ("//t.co/x", [])])
def test_slashes(spark, token, want):
    assert one(spark, R.split_slash(F.col("t")), t=token) == want


@pytest.mark.parametrize("token, want", [("Obama", "OBAMA"), ("obama", "obama"), ("NASA", "NASA")])
def test_capitals(spark, token, want):
    assert one(spark, R.capital_form(F.col("t")), t=token) == want


@pytest.mark.parametrize("token, title", [("Obama", True), ("NASA", False), ("O'Brien", True), ("obama", False), ("A", True), ("12", False)])
def test_title(spark, token, title):
    assert one(spark, R.is_title(F.col("t")), t=token) is title


def test_urls(spark):
    long = "https://www.instagram.com/p/CD7fAPWs3WM/?igshid=o9kf0ugp1l8x"
    assert one(spark, U.domain_terms(F.array("u")), u=long) == ["instagram"]
    assert one(spark, U.domain_terms(F.array("u")), u="https://twitter.com/i/web/status/1") == []
    assert sorted(one(spark, U.post_urls(F.col("t"), F.col("m")), t="x", m='{"https://t.co/a":"https://www.x.com/b","k":null}')) == ["https://www.x.com/b", "k"]
    assert one(spark, U.post_urls(F.col("t"), F.col("m")), t="a https://t.co/z b https://t.co/y", m="{}") == ["https://t.co/z"]
    assert one(spark, U.post_urls(F.col("t"), F.col("m")), t="a", m="not json") == []


def test_concat_and_lists(spark):
    for rq, q, want in (("b", "b", "a b"), ("b", "c", "a b c"), ("b", None, "a b"), (None, "c", "a c")):
        assert one(spark, U.concat_post(F.col("a"), F.col("rq"), F.col("q")), a="a", rq=rq, q=q) == want
    assert one(spark, U.int_list(F.col("s")), s="[174,203]") == [174, 203]
    assert one(spark, U.int_list(F.col("s")), s=None) == []


def test_dates(spark):
    assert str(one(spark, post_time(F.col("d")), d="Wed Jul 22 12:20:42 +0000 2020")) == "2020-07-22 12:20:42"
    assert one(spark, post_time(F.col("d")), d="bad") is None
    age = age_minutes(post_time(F.col("d")), F.lit("2020-07-24 14:21:42").cast("timestamp"))
    assert one(spark, age, d="Wed Jul 22 12:20:42 +0000 2020") == 3001


# published vocabulary examples
STEMS = """consigned:consign consignment:consign consistency:consist consolatory:consolatori consolidating:consolid consonant:conson
conspicuously:conspicu conspiracy:conspiraci conspirators:conspir constables:constabl constancy:constanc knackeries:knackeri
knavish:knavish kneaded:knead kneeling:kneel knightly:knight knitted:knit knives:knive knocker:knocker hopping:hop hoping:hope
running:run happy:happi cries:cri ties:tie communication:communic beautiful:beauti skies:sky generate:generat"""


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, stem = pair.split(":")
    assert porter2(word) == stem


def test_treebank(spark):
    got = one(spark, treebank_tokens(F.col("t")), t="He's got 1,234 dollars; can't stop. The U.S. economy (6% up) ended.")
    assert got == ["He", "'s", "got", "1,234", "dollars", ";", "ca", "n't", "stop", ".", "The", "U.S.", "economy", "(", "6", "%", "up", ")", "ended", "."]
    assert one(spark, treebank_tokens(F.col("t")), t=None) == []


def terms_of(spark, text, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [(r["pos"], r["term"]) for r in parse.parse(df, stem=False, **options).orderBy("pos", "is_entity", "term").collect()]


def test_parse_rules(spark):
    words = [t for _, t in terms_of(spark, "saw Barack Obama in New York City")]
    assert words == ["saw", "BARACK", "Barack Obama New York City", "OBAMA", "NEW", "YORK", "CITY"]
    assert [t for _, t in terms_of(spark, "hi @user bye # # # token")] == ["hi", "bye", "token"]
    assert terms_of(spark, "cost 55 million 22/07/2020 -3.5 x² 🙂") == [(0, "cost"), (1, "55M"), (2, "million"), (3, "22/07/2020"), (4, "3.5")]
    assert [t for _, t in terms_of(spark, "The the")] == ["THE"]
    assert terms_of(spark, None) == [] and terms_of(spark, "") == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("web status twitter.com i", []),  # never indexed
        ("see Web/Status/cnn", ["see", "Web", "Status", "cnn"]),  # only in lower case are they skipped
        ("see web/status/cnn", ["see", "cnn"]),
        ("end. x.", ["end", "x"]),  # one full stop goes
        ("a..", ["a."]),
        ("'tis -5 -x", ["tis", "-5", "x"]),
    ],
)
def test_skipped_words_and_edges(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = parse.parse(df, tokenizer=lambda c: F.split(c, " "), stop=[], stem=False).where("not is_entity").orderBy("pos")
    assert [r["term"] for r in got.collect()] == want


def test_treebank_rules_find_their_mark_first(spark):
    """No rule looks back, or takes any other letter, at every place of a text; what they do is what the plain forms do."""
    from lexora.functions.treebank import ABBREVIATIONS, RULES

    plain = [
        (rf"(?<!\b(?:{ABBREVIATIONS}|[A-Z])\.)(?<=[.!?])([\"')\]]*)[ \t\r\n]+(?=[\"'(\[]*[A-Z0-9])", "$1\n"),
        (r"([«“‘„]|[`]+)", " $1 "),
        (r"(?m)([^.])(\.)([\])}>\"'»”’ ]*)[ \t]*$", "$1 $2 $3 "),
        (r"([^' ])('[sS]|'[mM]|'[dD]|')(?= |\n|$)", "$1 $2"),
        (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)(?= |\n|$)", "$1 $2"),
    ]
    assert not [p for p, _ in RULES if p.startswith(("(?<", "([^' ]", "(?m)([^.]"))]
    text = "Dr. A. Fox said: ``Go!'' \"Now.\" He'll; she'S, they've\nI'm n't don't DON'T 'tis x's' a'd` ``b «c».  \nEnd.. of it.) 'll 've \U0001f600's \U0001f600n't U.S. [X] ok?  1."
    for (p, put), (q, with_) in zip(plain, [RULES[k] for k in (0, 1, 5, 15, 16)]):
        a, b = (one(spark, F.regexp_replace("t", x, y), t=text) for x, y in ((p, put), (q, with_)))
        assert a == b != text


def test_treebank_rules_are_tried_where_a_mark_asks(spark):
    """Rules that find no mark of theirs are left out; tokens are those of all rules in turn."""
    from functools import reduce

    from lexora.functions.treebank import MARKS, ORDINARY, RULES

    assert len(MARKS) == len(RULES) and len(ORDINARY) < len(RULES) / 3
    texts = ["", " \n", "Plain words, here. Mr. Fox cannot go. You gotta. ", "a,b 1,5, c,\nd.\n E. f", "cannot xcannot cannotx CanNot gimme LEMME wanna. gonna, gOtTa canno _gonna éwanna"]
    texts += [f"Aa cannot{m}b. {m}C{m} d, {m}{m}e." for m in ["«", "“", "`", "\"", "'", "''", "»", "’", ":", "..", ";", "@", "#", "&", "?", "!", "(", "]", "<", "--", "-", "d'ye ", "more'n ", " 'tis "]]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.filter(F.split(reduce(lambda t, rule: F.regexp_replace(t, *rule), RULES, F.col("t")), r"[ \t\r\n\f]+"), lambda x: x != "")
    got = d.select("t", treebank_tokens(F.col("t")).alias("a"), every.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[0]["a"] == got[1]["a"] == []
    assert got[4]["a"] == "can not xcannot cannotx Can Not gim me LEM ME wan na. gon na , gOt Ta canno _gonna éwanna".split()


def test_a_mark_alone_passes_no_rule(spark):
    """Single marks, the most frequent of the tokens that are not plain, give no term by any branch; they are asked first."""
    import string

    marks = " ".join(string.punctuation)
    for before, after in (("", ""), ("5 ", " million"), ("$ ", " 7")):
        df = spark.createDataFrame([(k, f"{before}{m}{after}") for k, m in enumerate(marks.split()) if m not in "@#"], "doc_id long, text string")
        got = {r["term"] for r in parse.parse(df, tokenizer=lambda c: F.split(c, " "), stop=[], stem=False).collect()}
        assert not got & {*string.punctuation} and "" not in got
    x = F.struct(F.lit("%").alias("t"), F.lit(".").alias("f"), F.lit(None).cast("string").alias("n"))
    tree = str(parse.token_terms(x, F.lit(""), F.lit(""))).lower()
    assert 0 < tree.index("'|', '}', '~')") < tree.index("rlike")
