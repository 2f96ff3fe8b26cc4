"""Where sentences end, learned from a corpus without labels: Kiss and Strunk's log-likelihoods of abbreviations, collocations and sentence starters.

One pass over the texts counts tokens by type, case and what stands before them. All else is of
these counts, whose rows are pairs of types and not tokens: which types are abbreviations, how a
type is written within and after sentences, which types open sentences, which pairs belong
together. A full stop ends a sentence by its type and the token after it, so the decisions are a
table too. Texts are marked by the decisions' sets inside the JVM if these are small, and by a join
if not.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import held
from ..plans.storage import spread, written
from .joins import small

# Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: A word with the full stop that follows it at once, or a mark.
LETTERS = r"[\p{L}\p{Nd}][\p{L}\p{Nd}'’-]*"
TOKEN = rf"{LETTERS}(?:[.,]{LETTERS})*\.?|[!?;:,]|\.+"
WORD = r"^[\p{L}\p{Nd}]"
NUMBER = r"^[\p{Nd}.,-]+$"
#: What stands between a mark and the next word, within one sentence or between two.
GAP = r"(?<=[.!?])([\"'”’)\]]*)[ \t\r\n\f]+(?=[\"'“‘(\[]*[\p{L}\p{Nd}])"
#: The word before a gap and the one after it.
BEFORE = rf"({LETTERS}(?:[.,]{LETTERS})*\.)[\"'”’)\]]*$"
AFTER = rf"^[\"'“‘(\[]*({LETTERS}(?:[.,]{LETTERS})*\.?)"
#: Several full stops end a sentence before a capital alone.
DOTS = r"\.\.[\"'”’)\]]*$"
#: Keys of decisions up to which they travel as sets with the plan, and code points that one may have.
MODEL_KEYS, KEY_CHARS = 50_000, 200
PART = "\u0002"


def token_type(t: Column) -> Column:
    """The token in lower case, without its full stop; numbers are one type. Marks are their own types."""
    # cheap tests come first: few tokens meet a second pattern
    bare = F.when(t.endswith(".") & t.rlike(WORD), F.left(t, F.length(t) - 1)).otherwise(t)
    return F.when(t.rlike(NUMBER) & t.rlike(WORD), "#").otherwise(F.lower(bare))


def _first_upper(t: Column) -> Column:
    first = F.substring(t, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first)


def _tokens(docs: DataFrame, *more: str, which=None) -> DataFrame:
    """Rows (tok, before, after, pos) of all tokens, or of those that ``which`` tells, and more columns."""
    found = F.coalesce(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    rows = held(spread(docs.select("text", *more)), "a", found)
    row = lambda t, i: F.struct(t.alias("tok"), F.get(F.col("a"), i - 1).alias("before"), F.get(F.col("a"), i + 1).alias("after"), i.alias("pos"))
    each = F.transform("a", row) if which is None else F.filter(F.transform("a", lambda t, i: F.when(which(t), row(t, i))), lambda x: x.isNotNull())
    return rows.select(*more, F.explode(each).alias("t")).select(*more, "t.*")


def _is_stop(t: Column, after: Column) -> Column:
    """A word with its full stop, which no other one follows."""
    return F.coalesce(t.endswith(".") & t.rlike(WORD), F.lit(False)) & ~F.coalesce(after.startswith("."), F.lit(False))


def token_counts(docs: DataFrame) -> DataFrame:
    """(type, stop, upper, kind, before, n): tokens by type, by whether a full stop follows at once, by case, and by place.

    kind is s at a text's start, b after ! or ?, p after a full stop, whose word's type is
    ``before``, and i elsewhere. Texts are read once; a null text has no tokens. Tokens as written
    are counted first, with what stands before them where that may matter: types, cases and places
    are made of what differs.
    """
    t, b = F.col("tok"), F.col("before")
    matters = b.endswith(".") | b.isin("!", "?")
    rows = _tokens(docs).select("tok", b.isNull().alias("first"), F.when(matters, b).alias("before"), F.coalesce(F.col("after").startswith("."), F.lit(False)).alias("dots"))
    rows = rows.groupBy("tok", "first", "before", "dots").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("first"), "s").when(b.isin("!", "?"), "b").when(_is_stop(b, t), "p").otherwise("i")
    stop = F.coalesce(t.endswith(".") & t.rlike(WORD), F.lit(False)) & ~F.col("dots")
    rows = rows.select(token_type(t).alias("type"), stop.alias("stop"), _first_upper(t).alias("upper"), kind.alias("kind"), F.when(kind == "p", token_type(b)).alias("before"), "n")
    return rows.groupBy("type", "stop", "upper", "kind", "before").agg(F.sum("n").alias("n"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """type, n_with, n_without, score of all types with a letter that a full stop follows anywhere.

    score: how much likelier the type's full stops are if nearly all its tokens have one, than if
    they come as often as with any token; short types and inner full stops count for it, tokens
    without a full stop against it.
    """
    n = counts.agg(F.sum("n").cast("double").alias("n_all"), F.sum(F.when(F.col("stop"), F.col("n"))).cast("double").alias("n_stops"))
    t = counts.groupBy("type").agg(F.coalesce(F.sum(F.when(F.col("stop"), F.col("n"))), F.lit(0)).alias("n_with"), F.coalesce(F.sum(F.when(~F.col("stop"), F.col("n"))), F.lit(0)).alias("n_without"))
    # one row of totals
    t = t.where((F.col("n_with") > 0) & F.col("type").rlike(r"\p{L}")).crossJoin(F.broadcast(n))
    a, b, p = F.col("n_with").cast("double"), F.col("n_without").cast("double"), F.col("n_stops") / F.col("n_all")
    # where every token has a full stop, the second term is 0 times a logarithm of 0
    by_chance = a * F.log(p) + F.when(b > 0, b * F.log(1 - p)).otherwise(0.0)
    likelihood = 2 * (a * F.log(F.lit(0.99)) + b * F.log(F.lit(0.01)) - by_chance)
    chars = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("type") - chars
    score = likelihood * F.exp(-chars) * (inner + 1) * F.pow(chars, -b)
    return t.select("type", "n_with", "n_without", score.alias("score"))


def association(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio: a and b occurrences, ab of them together, of n."""
    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    part = lambda k, m, p: F.when((p > 0) & (p < 1), k * F.log(p) + (m - k) * F.log(1 - p)).otherwise(0.0)
    p, p1, p2 = b / F.nullif(n, F.lit(0.0)), ab / F.nullif(a, F.lit(0.0)), (b - ab) / F.nullif(n - a, F.lit(0.0))
    return -2 * (part(ab, a, p) + part(b - ab, n - a, p) - part(ab, a, p1) - part(b - ab, n - a, p2))


@dataclass
class Sentences:
    """A corpus's model as tables: abbreviations(type), starters(type), collocations(before, type), decisions(before, type, upper, is_break) of all that follows a full stop; and the sets that the plan carries, None if they are too large."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    decisions: DataFrame
    sets: dict[str, list[str]] | None = field(default=None)


def _with(rows: DataFrame, flags: DataFrame, name: str, *keys: str) -> DataFrame:
    """rows with a boolean: whether its keys are among those of flags."""
    named = flags.select(*[F.col(f).alias(f"__{k}") for k, f in zip(keys, flags.columns)]).withColumn(f"__{name}", F.lit(True))
    on = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"__{k}") for k in keys])
    return rows.join(small(named), on, "left").withColumn(name, F.coalesce(f"__{name}", F.lit(False))).drop(f"__{name}", *[f"__{k}" for k in keys])


def _single(c: str) -> Column:
    return F.col(c).rlike(r"^\p{L}$")


def learn_sentences(docs: DataFrame, limit: int = MODEL_KEYS) -> Sentences:
    """The model of ``docs(text)``, of one pass over the texts. No text is needed again."""
    counts = written(token_counts(docs))
    n_all = float(counts.agg(F.sum("n")).first()[0] or 0)
    abbreviations = written(abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION).select("type"))
    rows = written(_with(counts, abbreviations, "after_short", "before"))
    ends = F.col("kind").isin("s", "b") | ((F.col("kind") == "p") & ~F.col("after_short"))
    word, lone = F.col("type").rlike(WORD) | (F.col("type") == "#"), F.col("before").isNotNull() & (_single("before") | (F.col("before") == "#"))
    upper, amount = F.col("upper"), F.col("n")
    some = lambda c: F.coalesce(F.sum(F.when(c, amount)), F.lit(0))
    alpha = F.col("type").rlike(r"^\p{L}+$")
    at_break = (F.col("kind") == "b") | ((F.col("kind") == "p") & ~F.col("after_short") & ~lone)
    types = written(rows.groupBy("type").agg(
        F.sum("n").alias("n"), some(at_break & alpha).alias("n_break"), (some(word & ~upper) > 0).alias("low"), (some(word & upper) > 0).alias("up"),
        (some(upper & ~ends & (F.col("kind") != "p")) > 0).alias("mid_up"), (some(word & ~upper & ends) > 0).alias("beg_low"),
    ))
    stops = rows.where("stop").join(small(abbreviations), "type", "left_anti").agg(F.sum("n")).first()[0] or 0
    marks = types.where(F.col("type").isin("!", "?")).agg(F.sum("n")).first()[0] or 0
    breaks = float(stops + marks)
    at = F.col("n_break")
    starters = types.where((at > 0) & (F.col("n") >= at)).where((association(F.lit(breaks), F.col("n"), at, F.lit(n_all)) >= STARTER) & (n_all * at > breaks * F.col("n"))).select("type")
    starters = written(starters)
    pairs = rows.where(lone & word).groupBy("before", "type").agg(F.sum("n").alias("n_pair")).where("n_pair > 1")
    by = types.select("type", "n")
    pairs = pairs.join(by.withColumnsRenamed({"type": "before", "n": "n_before"}), "before").join(by.withColumnRenamed("n", "n_type"), "type").where((F.col("n_before") > 1) & (F.col("n_type") > 1) & (F.col("n_pair") <= F.least("n_before", "n_type")))
    strong = association(F.col("n_before"), F.col("n_type"), F.col("n_pair"), F.lit(n_all)) >= COLLOCATION
    collocations = written(pairs.where(strong & (n_all * F.col("n_pair") > F.col("n_before") * F.col("n_type"))).select("before", "type"))
    # how a type is written tells whether its case means a new sentence: T, or F, or neither
    case = rows.where("kind = 'p'").select("before", "type", "upper", "after_short").distinct().join(types.select("type", "low", "up", "mid_up", "beg_low"), "type")
    case = _with(_with(case, starters, "starts", "type"), collocations, "bound", "before", "type")
    is_word = F.col("type").rlike(WORD) | (F.col("type") == "#")
    opens = F.when(~is_word, "F").when(upper & F.col("low") & ~F.col("mid_up"), "T").when(~upper & (F.col("up") | ~F.col("beg_low")), "F").otherwise("U")
    lone = _single("before") | (F.col("before") == "#")
    ends = (
        F.when(F.col("bound"), False)
        .when(F.col("after_short") & ~_single("before") & ((opens == "T") | (upper & F.col("starts"))), True)
        .when(lone & (opens == "F"), False)
        .when(_single("before") & (opens == "U") & upper & ~F.col("low"), False)
        .otherwise(~F.col("after_short"))
    )
    decisions = written(case.select("before", "type", "upper", ends.alias("is_break")))
    model = Sentences(abbreviations, starters, collocations, decisions)
    model.sets = decision_sets(model, limit)
    return model


def _key(before: Column, kind: Column, upper: Column) -> Column:
    return F.concat(before, F.when(upper, " U ").otherwise(" l "), kind)


def decision_sets(model: Sentences, limit: int = MODEL_KEYS) -> dict[str, list[str]] | None:
    """The abbreviations, and the pairs that are decided otherwise than they tell; None if these are more than ``limit``, or one is very long."""
    odd = _with(model.decisions, model.abbreviations, "short", "before").where(F.col("is_break") == F.col("short"))
    keys = {"short": model.abbreviations.select(F.col("type").alias("k")), "odd": odd.select(_key(F.col("before"), F.col("type"), F.col("upper")).alias("k"))}
    found = {name: [r["k"] for r in k.limit(limit + 1).collect()] for name, k in keys.items() if k.where(F.length("k") > KEY_CHARS).limit(1).count() == 0}
    return found if len(found) == 2 and sum(map(len, found.values())) <= limit else None


def _parts(text: Column) -> Column:
    """The text cut at its gaps: (p, stop, after, upper, last) with the type of the word before each gap, if a full stop ends it alone, and of the one after."""
    parts = F.split(F.regexp_replace(text, GAP, f"$1{PART}"), PART)

    def one(p: Column, following: Column) -> Column:
        word, after = F.regexp_extract(p, BEFORE, 1), F.regexp_extract(following, AFTER, 1)
        stop = F.when((word != "") & ~p.rlike(DOTS), token_type(word))
        return F.struct(p.alias("p"), stop.alias("stop"), token_type(after).alias("after"), _first_upper(after).alias("upper"), p.rlike(DOTS).alias("dots"), following.isNull().alias("last"))

    return F.zip_with(parts, F.slice(F.concat(parts, F.array(F.lit(None).cast("string"))), F.lit(2), F.size(parts)), one)


def _joined(x: Column, end: Column) -> Column:
    end = F.when(x["dots"], x["upper"]).otherwise(F.coalesce(end, F.lit(True)))
    return F.when(x["last"], x["p"]).otherwise(F.concat(x["p"], F.when(end, "\n").otherwise(" ")))


def mark_sentences(text: Column, sets: dict[str, list[str]]) -> Column:
    """The text with a line break where a sentence ends, and a blank in other gaps after marks; by a model's sets, inside the JVM."""
    among = lambda c, name: c.isin(sets[name]) if sets[name] else c.isNotNull() & F.lit(False)
    end = lambda x: among(x["stop"], "short") == among(_key(x["stop"], x["after"], x["upper"]), "odd")
    return F.array_join(F.transform(_parts(text), lambda x: _joined(x, end(x))), "")


def marked_texts(docs: DataFrame, model: Sentences) -> DataFrame:
    """docs with their texts marked: by the model's sets, or, where these are too large to travel, by joins of the gaps and one exchange by row. A null text stays null."""
    if model.sets is not None:
        return docs.withColumn("text", mark_sentences(F.col("text"), model.sets))
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    gaps = rows.where(F.col("text").isNotNull()).select("__row", F.posexplode(_parts(F.col("text"))).alias("at", "x"))
    gaps = gaps.withColumn("stop", F.col("x.stop"))
    on = (F.col("stop") == F.col("before")) & (F.col("x.after") == F.col("type")) & (F.col("x.upper") == F.col("up"))
    told = gaps.join(small(model.decisions.withColumnRenamed("upper", "up")), on, "left")
    told = _with(told, model.abbreviations, "short", "stop")
    end = F.coalesce("is_break", F.when(F.col("stop").isNotNull(), ~F.col("short")))
    whole = told.select("__row", "at", _joined(F.col("x"), end).alias("p")).groupBy("__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda y: y["p"]), "").alias("__text"))
    return rows.join(whole, "__row", "left").withColumn("text", F.col("__text")).drop("__row", "__text")


def boundaries(docs: DataFrame, model: Sentences, key: str = "doc_id") -> DataFrame:
    """key, pos, is_break of every token that may end a sentence and is not its text's last: words with a full stop, ! and ?. pos counts tokens; by joins, of any size of model. Texts are cut once, what may end a sentence is written."""
    t, a = F.col("tok"), F.col("after")
    rows = _tokens(docs, key, which=lambda t: t.endswith(".") | t.isin("!", "?")).where(a.isNotNull() & (_is_stop(t, a) | t.isin("!", "?")))
    rows = written(rows.select(key, "pos", F.when(_is_stop(t, a), token_type(t)).alias("before"), token_type(a).alias("type"), _first_upper(a).alias("upper")))
    told = rows.where(F.col("before").isNotNull()).join(small(model.decisions), ["before", "type", "upper"])
    return told.select(key, "pos", "is_break").unionAll(rows.where(F.col("before").isNull()).select(key, "pos", F.lit(True).alias("is_break")))
