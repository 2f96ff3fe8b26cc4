"""From texts to term rows: each text is cut into tokens once, what its tokens give is exploded once. Nothing is shuffled here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.arrays import held, let, run_starts, runs
from ..functions.stem import stem_terms
from ..functions.treebank import treebank_tokens
from ..functions.urls import domain_terms
from ..functions.words import PUNCTUATION, SKIPPED, STOP_WORDS, URL_IN_QUERY

SEP = "\u0001"


def _none() -> Column:
    return F.array().cast("array<string>")


def without_stop_words(tokens: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Case-sensitive: 'The' stays, 'the' goes."""
    return F.filter(tokens, lambda t: ~t.isin(stop)) if stop else tokens


def consumed(tokens: Column) -> Column:
    """A flag for each token: A for a mention or hashtag mark that takes the next token, x for what is taken, '.' for the rest.

    Marks take in pairs from the left, so in a run of marks the second belongs to the first.
    """
    marks = F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("@") | t.startswith("#"), "M").otherwise(".")), "")
    return F.split(F.regexp_replace(marks, "M[\\s\\S]", "Ax"), "")


def drop_consumed(tokens: Column, flags: Column) -> Column:
    """(t, f, n) of each token that no mark takes: the token, its flag, and the token after it, which a mark takes. Both columns must be held()."""
    rows = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.get(flags, i).alias("f"), F.get(tokens, i + 1).alias("n")))
    return F.filter(rows, lambda x: x["f"] != "x")


def kept_tokens(texts: DataFrame, tokens: Column) -> DataFrame:
    """texts with x, the result of drop_consumed."""
    rows = held(texts, "tokens", tokens)
    rows = held(rows, "flags", consumed(F.col("tokens")))
    return held(rows, "x", drop_consumed(F.col("tokens"), F.col("flags"))).drop("tokens", "flags")


LATIN = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"


def is_plain(t: Column) -> Column:
    """Most tokens are plain Latin words: no rule but the capital form applies to them."""
    return t.rlike(f"^{LATIN}+$") & ~t.isin(SKIPPED)


def kept_terms(terms: Column) -> Column:
    return F.filter(terms, lambda w: ~w.isin([*SKIPPED, ""]))


def token_terms(x: Column, before: Column, after: Column, keep_full_tag: bool = False, stop: list[str] = STOP_WORDS) -> Column:
    """Terms of one token (a struct of drop_consumed) between its neighbours. Branches are in order of precedence."""
    t = x["t"]
    rest = F.substr(t, F.lit(2))
    hyphen = t.contains("-") & ~t.startswith("-")
    emoji = ~hyphen & R.is_emoji(t)
    cut = F.when(hyphen, t).when(t.startswith("'") | t.startswith("-"), rest).when(t.endswith("."), F.regexp_replace(t, r"\.$", "")).otherwise(t)
    first = F.when(hyphen, R.split_hyphen(t)).when(t.startswith("'") | t.startswith("-") | t.endswith("."), _none()).when(R.is_alpha(t), F.array(R.capital_form(t))).otherwise(_none())
    numbers = F.when(hyphen, _none()).otherwise(R.number_terms(t, before, after))
    slash = R.split_slash(cut)
    terms = (
        F.when(t.isin(SKIPPED) | emoji, _none())
        .when((x["f"] == "A") & t.startswith("@"), _none())
        .when((x["f"] == "A") & t.startswith("#"), R.split_hashtag(F.concat(rest, x["n"]), keep_full_tag))
        .when(R.is_date(t), F.array(cut))
        .otherwise(let(numbers, lambda found: F.when(F.size(found) > 0, found).otherwise(F.concat(first, slash))))
    )
    stops = cut.isin(stop) if stop else F.lit(False)
    fallback = F.when(emoji | t.isin(SKIPPED) | cut.contains("//t") | cut.isin(PUNCTUATION) | stops | ~R.is_ascii(cut), _none()).otherwise(F.array(F.lower(cut)))
    # a mark alone gives no term by any branch, and most tokens that are not plain are marks
    chosen = F.when((x["f"] == ".") & t.isin(PUNCTUATION), _none()).when((x["f"] == ".") & is_plain(t), F.array(R.capital_form(t))).otherwise(let(terms, lambda found: F.when(F.size(found) > 0, found).otherwise(fallback)))
    return kept_terms(chosen)


def entity_phrases(tokens: Column) -> Column:
    """(pos, phrase) of maximal runs of two or more adjacent title-case tokens that begin with an alphabetic one."""
    kind = lambda t: F.when(R.is_title(t), F.when(R.is_alpha(t), "A").otherwise("T")).when(R.is_title_hyphen(t), "T").otherwise(".")
    # only tokens with a capital are written out and pass the dearer tests; a dot parts those that are not neighbours
    cased = F.filter(F.transform(tokens, lambda t, i: F.when(F.lower(t) != t, F.struct(i.alias("i"), t.alias("t")))), lambda y: y.isNotNull())
    gap = lambda c, y, k: F.when(F.get(c, k - 1)["i"] == y["i"] - 1, "").otherwise(f".{SEP}")
    # and only those beside another one can be of a run
    beside = lambda c, y, k: F.coalesce(F.get(c, k - 1)["i"] == y["i"] - 1, F.lit(False)) | F.coalesce(F.get(c, k + 1)["i"] == y["i"] + 1, F.lit(False))
    cased = let(cased, lambda c: F.filter(F.transform(c, lambda y, k: F.when(beside(c, y, k), y)), lambda y: y.isNotNull()))
    line = let(cased, lambda c: F.array_join(F.transform(c, lambda y, k: F.concat(gap(c, y, k), kind(y["t"]), y["i"].cast("string"), F.lit(":"), y["t"])), SEP))
    runs = F.regexp_extract_all(line, F.lit(f"(?<=^|{SEP})A\\d+:[^{SEP}]+(?:{SEP}[AT]\\d+:[^{SEP}]+)++"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.regexp_extract(r, r"^A(\d+):", 1).cast("int").alias("pos"), F.regexp_replace(F.regexp_replace(r, r"^A\d+:", ""), f"{SEP}[AT]\\d+:", " ").alias("phrase")))


def url_terms(texts: DataFrame, queries: bool) -> Column:
    """A text's URL terms: a document's come with it, a query's are found in its text."""
    if queries:
        return domain_terms(F.regexp_extract_all(F.col("text"), F.lit(URL_IN_QUERY), F.lit(0)))
    return F.coalesce(F.col("url_terms"), _none()) if "url_terms" in texts.columns else _none()


def is_number(t: Column) -> Column:
    """A token of which the number rules may make terms."""
    return t.rlike(r"\p{Nd}") & R.letterless(t) & ~R.is_date(t)


def parsed_tokens(texts: DataFrame, key: str, tokenizer, stop: list[str], queries: bool) -> DataFrame:
    """key, t (the tokens that no mark takes), m (the result of drop_consumed where a text has marks, else null) and u (URL terms) of each text."""
    own = texts.select(key, "text", *(["url_terms"] if "url_terms" in texts.columns else []))
    rows = held(own, "tokens", without_stop_words(tokenizer(F.col("text")), stop)).select(key, "tokens", url_terms(own, queries).alias("u"))
    marked = F.exists("tokens", lambda t: t.startswith("@") | t.startswith("#"))
    rows = held(rows, "m", F.when(marked, let(consumed(F.col("tokens")), lambda flags: drop_consumed(F.col("tokens"), flags))))
    return held(rows, "t", F.when(F.col("m").isNull(), F.col("tokens")).otherwise(F.transform("m", lambda x: x["t"]))).select(key, "t", "m", "u")


def _at(i: Column) -> Column:
    """(x, before, after) of a kept token by its place, of parsed_tokens() rows."""
    m, t = F.get(F.col("m"), i), lambda i: F.get(F.col("t"), i)
    return F.struct(F.struct(t(i).alias("t"), F.coalesce(m["f"], F.lit(".")).alias("f"), m["n"].alias("n")).alias("x"), t(i - 1).alias("before"), t(i + 1).alias("after"))


def parse(texts: DataFrame, key: str = "doc_id", tokenizer=treebank_tokens, stop: list[str] = STOP_WORDS, stem: bool = True, queries: bool = False, keep_full_tag: bool = False) -> DataFrame:
    """Term rows of ``texts(key, text[, url_terms])``, one an occurrence: key, term, pos (null for URL terms), is_entity, is_number.

    Documents' own URL terms come with them; queries' are found in their text. A null text has no
    terms. ``stem`` stems alphabetic terms but not URL terms. Texts are read and cut into tokens once,
    and a token's terms are made inside the row: exploded rows have nothing left to compute.
    """
    item = lambda kind, term, pos, number: F.struct(term.alias("term"), pos.alias("pos"), F.lit(kind).alias("kind"), number.alias("is_number"))
    rows = parsed_tokens(texts, key, tokenizer, stop, queries)
    no = F.lit(False)
    plain = lambda t, i: F.transform(kept_terms(F.array(R.capital_form(t))), lambda w: item("w", w, i, no))
    other = lambda y, i: F.transform(token_terms(y["x"], y["before"], y["after"], keep_full_tag, stop), lambda w: item("w", w, i, is_number(y["x"]["t"])))
    words = F.flatten(F.transform("t", lambda t, i: F.when(is_plain(t), plain(t, i)).otherwise(let(_at(i), lambda y: other(y, i)))))
    phrases = F.transform(entity_phrases(F.col("t")), lambda p: item("e", p["phrase"], p["pos"], no))
    urls = F.transform("u", lambda u: item("u", u, F.lit(None).cast("int"), no))
    out = rows.select(key, F.explode(F.concat(words, phrases, urls)).alias("z")).select(key, "z.*")
    if stem:
        out = stem_terms(out.withColumn("to_stem", F.when(F.col("kind") != "u", F.col("term"))), "to_stem").withColumn("term", F.coalesce("to_stem", "term"))
    return out.select(key, "term", "pos", (F.col("kind") == "e").alias("is_entity"), "is_number")


#: Follows the lower form of a word in capitals: sorted, the two stand side by side.
CAPITAL = "\u0001"
#: Plain words whose capitals and lower letters go back and forth: a form in capitals is the capitals of its lower form.
REGULAR = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0132-\u0148\u014A-\u017E]"


def _side_by_side(t: Column) -> Column:
    """A regular word as its capital_form() in lower letters, marked if that is in capitals."""
    first = lambda t: F.substring(t, 1, 1)
    return F.when(F.lower(t) == t, t).when((F.upper(first(t)) == first(t)) & (F.lower(first(t)) != first(t)), F.concat(F.lower(F.upper(t)), F.lit(CAPITAL))).otherwise(F.lower(t))


def _merged_words(items: Column) -> Column:
    """Items of sums (form, kind, tf, numbers) as one each form: sorted by lower form, that form last of those not in capitals, those in capitals after it."""
    base = lambda z: F.lower(z["form"])
    order = lambda z: F.when((F.upper(z["form"]) == z["form"]) & (base(z) != z["form"]), 2).when(base(z) == z["form"], 1).otherwise(0)
    keyed = F.sort_array(F.transform(items, lambda z: F.struct(base(z).alias("base"), order(z).alias("k"), z["form"].alias("form"), z["tf"].alias("tf"), z["numbers"].alias("numbers"))))
    end = lambda starts, i, n: F.coalesce(F.get(starts, i + 1), n)

    def summed(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i)["form"] != F.get(a, i - 1)["form"]))
        add = lambda part, f: F.aggregate(part, F.lit(0).cast("long"), lambda x, z: x + z[f])
        run = lambda s, n: let(F.slice(a, s + 1, n), lambda part: F.struct(*[F.get(a, s)[f].alias(f) for f in ("base", "k", "form")], add(part, "tf").alias("tf"), add(part, "numbers").alias("numbers")))
        return let(starts, lambda starts: F.transform(starts, lambda s, i: run(s, end(starts, i, F.size(a)) - s)))

    return let(keyed, summed)


def parse_counts(texts: DataFrame, key: str = "doc_id", tokenizer=treebank_tokens, stop: list[str] = STOP_WORDS, queries: bool = False, keep_full_tag: bool = False) -> DataFrame:
    """parse() without stems and positions, counted inside a text's own row: key, form, kind, tf, numbers, doc_length, and low, more, more_numbers, top, head.

    kind is w for words, e for entities, u for URL terms. Plain words are sorted and counted inside
    the row, and the terms of other tokens are made there. Nothing is shuffled, each text is read once.
    doc_length is the number of tokens left after stop words and taken tokens.

    What folding by case makes of a text that is a document of its own is told here too, so it need not be dealt again:
    ``low`` says of a form in capitals that the text has its lower form, whose ``more`` and ``more_numbers`` are what those in
    capitals add; ``top`` is the highest sum then, whatever becomes of the other forms in capitals and of entities. It is
    null where that is not known: two forms in capitals have one lower form, URL terms or rare spellings may be equal to words. ``head`` marks one row a text.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    item = lambda kind, form, tf=one, numbers=zero: F.struct(form.alias("form"), F.lit(kind).alias("kind"), tf.alias("tf"), numbers.alias("numbers"))
    rows = parsed_tokens(texts, key, tokenizer, stop, queries).withColumn("doc_length", F.size("t"))
    # one look at all of a text's tokens tells for most texts that they are regular; else which are is asked once (marks are not), the others go with what stands beside them
    regular = F.array_join("t", "").rlike(f"^{REGULAR}*$") & ~F.arrays_overlap("t", F.array(*map(F.lit, SKIPPED)))
    rows = held(rows, "p", F.when(~regular, F.transform("t", lambda t: t.rlike(f"^{REGULAR}+$") & ~t.isin(SKIPPED))))
    plain = F.when(F.col("p").isNull(), F.col("t")).otherwise(F.filter("t", lambda t, i: F.get(F.col("p"), i)))
    rows = held(rows, "w", F.sort_array(F.transform(plain, _side_by_side)))
    rows = held(rows, "s", F.filter(F.transform("w", lambda w, i: F.when((i == 0) | (w != F.get(F.col("w"), i - 1)), i)), lambda i: i.isNotNull()))
    number = lambda y: F.when(is_number(y["x"]["t"]), one).otherwise(zero)
    others = F.filter(F.transform("p", lambda p, i: F.when(~p, _at(i))), lambda y: y.isNotNull())
    ruled = F.flatten(F.transform(others, lambda y: F.transform(token_terms(y["x"], y["before"], y["after"], keep_full_tag, stop), lambda w: item("w", w, one, number(y)))))
    rows = held(rows, "o", F.when(F.col("p").isNotNull(), ruled))
    merged = F.when(F.col("p").isNotNull(), F.when(F.size("o") > 0, _merged_words(F.col("o"))))
    # runs of words, sorted, so that what stands beside one in the array is the run beside it
    w, at, n = F.col("w"), lambda i: F.get(F.col("s"), i), F.size("w")
    end = lambda k: F.coalesce(at(k + 1), n)
    run = lambda s, k: _beside("w", F.get(w, s), F.lit(None).cast("string"), end(k) - s, zero, F.get(w, s - 1), F.get(w, end(k)), end(k + 1) - end(k), None)
    rows = held(held(rows, "g", F.transform("s", run)).withColumnRenamed("m", "marks"), "m", merged)
    # rules seldom make a form that a plain word is too; only then are all sorted together
    clash = F.arrays_overlap(F.flatten(F.transform("m", lambda z: F.array(z["base"], F.concat(z["base"], F.lit(CAPITAL))))), w)
    words = F.transform("g", lambda z: F.struct(_form(z["w"]).alias("form"), z["tf"].alias("tf"), z["numbers"].alias("numbers")))
    ruled = F.transform("m", lambda z: F.struct(z["form"].alias("form"), z["tf"].alias("tf"), z["numbers"].alias("numbers")))
    rows = held(rows, "a", F.when(F.col("m").isNull(), F.col("g")).when(~clash, F.concat("g", _in_order(F.col("m")))).otherwise(let(_merged_words(F.concat(words, ruled)), _in_order)))
    rows = held(rows, "e", _counted_phrases(F.col("t")))
    capitals = F.transform(F.filter("a", lambda z: z["w"].endswith(CAPITAL)), lambda z: z["w"])
    alike = let(capitals, lambda c: F.size(F.array_distinct(c)) < F.size(c))
    spaced = F.exists("m", lambda z: z["form"].contains(" "))
    doubt = (F.size("u") > 0) | F.arrays_overlap("w", F.array(*map(F.lit, SKIPPED))) | F.when(F.col("m").isNotNull(), alike | (spaced & (F.size("e") > 0))).otherwise(False)
    top = lambda a, f: F.coalesce(F.array_max(F.transform(a, f)), zero)
    rows = held(rows, "top", let(top("a", lambda z: z["tf"] + z["more"]), lambda m: F.when(~doubt & (top("e", lambda z: z["tf"]) <= m), m)))
    none = F.lit(None).cast("string")
    phrases = F.transform("e", lambda z: _beside("e", none, z["form"], z["tf"], zero, none, none, zero, None))
    urls = F.transform("u", lambda u: _beside("u", none, u, one, zero, none, none, zero, None))
    out = rows.select(key, F.posexplode(F.when((F.size("e") > 0) | (F.size("u") > 0), F.concat("a", phrases, urls)).otherwise(F.col("a"))).alias("i", "z"), "doc_length", "top")
    own = ["z.kind", "z.tf", "z.numbers", "doc_length", "z.low", "z.more", "z.more_numbers", "top"]
    out = out.select(key, F.coalesce("z.form", _form(F.col("z.w"))).alias("form"), *own, (F.col("i") == 0).alias("head"))
    return out.where((F.col("kind") != "w") | ~F.col("form").isin(SKIPPED))


def parse_forms(texts: DataFrame, key: str = "doc_id", tokenizer=treebank_tokens, stop: list[str] = STOP_WORDS, keep_full_tag: bool = False) -> DataFrame:
    """parse_counts() for an index of stems: key, form, kind, tf, numbers, doc_length, where plain words are counted as they stand, kind t.

    An index of stems adds its terms up by document whatever a text tells of its forms, so nothing is made of a plain word here:
    canonical_forms() makes its capital form and its stem, once a form of the corpus and not once a text. A text may have two rows of one term.
    """
    zero = F.lit(0).cast("long")
    item = lambda kind, form, tf, numbers=zero: F.struct(F.lit(kind).alias("kind"), form.alias("form"), tf.cast("long").alias("tf"), numbers.alias("numbers"))
    rows = parsed_tokens(texts, key, tokenizer, stop, False).withColumn("doc_length", F.size("t"))
    # one look at all of a text's tokens tells whether rules apply to any; else each is asked once, the others go with what stands beside them
    plain = F.array_join("t", "").rlike(f"^{LATIN}*$") & ~F.arrays_overlap("t", F.array(*map(F.lit, SKIPPED)))
    rows = held(rows, "p", F.when(~plain, F.transform("t", is_plain)))
    rows = held(rows, "w", F.sort_array(F.when(F.col("p").isNull(), F.col("t")).otherwise(F.filter("t", lambda t, i: F.get(F.col("p"), i)))))
    rows = held(rows, "s", run_starts("w"))
    others = F.filter(F.transform("p", lambda p, i: F.when(~p, _at(i))), lambda y: y.isNotNull())
    ruled = F.flatten(F.transform(others, lambda y: F.transform(token_terms(y["x"], y["before"], y["after"], keep_full_tag, stop), lambda w: F.struct(w.alias("form"), is_number(y["x"]["t"]).alias("number")))))
    rows = held(rows, "o", F.when(F.col("p").isNotNull(), F.sort_array(ruled)))
    rows = held(rows, "r", F.when(F.size("o") > 0, run_starts("o")))
    sums = F.transform(runs("o", "r"), lambda r: item("w", r["term"]["form"], r["tf"], F.when(r["term"]["number"], r["tf"].cast("long")).otherwise(zero)))
    rows = held(rows, "g", F.transform("s", lambda s, k: item("t", F.get(F.col("w"), s), F.coalesce(F.get(F.col("s"), k + 1), F.size("w")) - s)))
    rows = held(rows, "e", _counted_phrases(F.col("t")))
    phrases, urls = F.transform("e", lambda z: item("e", z["form"], z["tf"])), F.transform("u", lambda u: item("u", u, F.lit(1)))
    more = lambda a: F.coalesce(a, F.array().cast("array<struct<kind:string,form:string,tf:bigint,numbers:bigint>>"))
    some = F.col("r").isNotNull() | (F.size("e") > 0) | (F.size("u") > 0)
    return rows.select(key, F.explode(F.when(some, F.concat("g", more(sums), phrases, urls)).otherwise(F.col("g"))).alias("z"), "doc_length").select(key, "z.form", "z.kind", "z.tf", "z.numbers", "doc_length")


def _beside(kind: str, w: Column, form: Column, tf: Column, numbers: Column, before: Column, after: Column, more: Column, more_numbers: Column) -> Column:
    """A form as it is sorted, itself if that does not tell, its sums, whether its lower form stands before it and what its capitals after it add."""
    zero = F.lit(0).cast("long")
    low = F.when(w.endswith(CAPITAL), F.coalesce(before == F.left(w, F.length(w) - 1), F.lit(False))).otherwise(False)
    add = lambda c: F.when(after.endswith(CAPITAL), F.when(after == F.concat(w, F.lit(CAPITAL)), c.cast("long")))
    sums = {"tf": tf.cast("long"), "numbers": numbers, "more": F.coalesce(add(more), zero), "more_numbers": zero if more_numbers is None else F.coalesce(add(more_numbers), zero)}
    return F.struct(F.lit(kind).alias("kind"), w.alias("w"), form.alias("form"), low.alias("low"), *[c.alias(k) for k, c in sums.items()])


def _form(w: Column) -> Column:
    return F.when(w.endswith(CAPITAL), F.upper(F.left(w, F.length(w) - 1))).otherwise(w)


def _in_order(merged: Column) -> Column:
    """_merged_words() as runs of words are written."""
    at = lambda i: F.get(merged, i)
    w = lambda z: F.when(z["k"] == 2, F.concat(z["base"], F.lit(CAPITAL))).otherwise(z["form"])
    return F.transform(merged, lambda z, i: _beside("w", w(z), z["form"], z["tf"], z["numbers"], w(at(i - 1)), w(at(i + 1)), at(i + 1)["tf"], at(i + 1)["numbers"]))


def _counted_phrases(tokens: Column) -> Column:
    """(form, tf) of each of entity_phrases()."""
    names = F.transform(entity_phrases(tokens), lambda p: p["phrase"])
    return let(names, lambda names: F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("form"), F.size(F.filter(names, lambda m: m == n)).cast("long").alias("tf"))))


def parse_lengths(texts: DataFrame, key: str = "doc_id", tokenizer=treebank_tokens, stop: list[str] = STOP_WORDS) -> DataFrame:
    """key and doc_length: tokens after stop words and taken tokens are gone."""
    return kept_tokens(texts.select(key, "text"), without_stop_words(tokenizer(F.col("text")), stop)).select(key, F.size("x").alias("doc_length"))
