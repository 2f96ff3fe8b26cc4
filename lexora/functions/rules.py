"""Scalar text rules as Column expressions: all run inside the JVM, none shuffles.

A rule that looks at neighbours takes them as columns, so that a whole text's rules run as one
``transform`` over its array of tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .words import DATE, EMOJI, KEPT_LETTERS, NUMBER, QUANTITIES, SIGNS


def keep_latin(text: Column) -> Column:
    """Without characters outside ASCII, Latin-1, Latin Extended and the right quote."""
    return F.regexp_replace(text, KEPT_LETTERS, "")


def simple_tokens(text: Column, pattern: str = "[a-z]+", lower: bool = True) -> Column:
    """All matches of the pattern, of the lowered text if asked; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def is_alpha(t: Column) -> Column:
    return t.rlike(r"^\p{L}+$")


def is_title(t: Column) -> Column:
    """Every run of letters starts with an upper letter and goes on in lower ones; there is one at least."""
    return t.rlike(r"^\P{L}*(?:[\p{Lu}\p{Lt}][\p{Ll}\p{Lo}\p{Lm}]*(?:\P{L}+|$))+$")


def is_title_hyphen(t: Column) -> Column:
    """Title case on both sides of the first hyphen."""
    head, tail = F.regexp_extract(t, "^([^-]*)-", 1), F.regexp_extract(t, "^[^-]*(-.*)$", 1)
    return t.contains("-") & is_title(head) & is_title(tail)


def letterless(t: Column) -> Column:
    return ~t.rlike(r"\p{L}")


def is_date(t: Column) -> Column:
    """Two groups of one to four digits around '-', '.' or '/': also decimals and fractions."""
    return letterless(t) & t.rlike(DATE)


def is_emoji(t: Column) -> Column:
    return t.rlike(EMOJI)


def is_ascii(t: Column) -> Column:
    return t.rlike(r"^[\x21-\x7F]*$")


def capital_form(t: Column) -> Column:
    """Alphabetic token: all upper if its first letter is, else all lower."""
    first = F.substring(t, 1, 1)
    return F.when((F.upper(first) == first) & (F.lower(first) != first), F.upper(t)).otherwise(F.lower(t))


def split_hyphen(t: Column) -> Column:
    """Lower-case parts if any is alphabetic, else the token itself; empty parts are dropped."""
    parts = F.split(t, "-")
    return F.when(F.exists(parts, is_alpha), F.filter(F.transform(parts, F.lower), lambda x: x != "")).otherwise(F.array(t))


def split_slash(t: Column) -> Column:
    """Parts of two characters or more, unless the token holds //t."""
    return F.when(t.contains("/") & ~t.contains("//t"), F.filter(F.split(t, "/"), lambda x: F.length(x) > 1)).otherwise(F.array().cast("array<string>"))


def split_hashtag(tag: Column, keep_full_tag: bool = False) -> Column:
    """Camel-case, digit and underscore pieces of a tag (without #), lowered, with what lies between; optionally the tag itself."""
    tag = F.split(tag, "#")[0]
    pieces = F.regexp_extract_all(tag, F.lit(r"[A-Z]*[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9_-]+"), F.lit(0))
    pieces = F.transform(pieces, F.lower)
    return F.concat(F.array(F.lower(F.concat(F.lit("#"), tag))), pieces) if keep_full_tag else pieces


#: From here on a double's shortest digits, which format_number prints, may lack places that it has; 2 ** 40.
EXACT = float(1 << 40)
#: Decimal digits of long numbers are added up in groups of nine, their powers of two in steps of 24.
GROUP, STEP = 1_000_000_000, 24


def _div(v: Column) -> Column:
    """A long divided by GROUP, without its rest; in longs."""
    return F.call_function("div", v, F.lit(GROUP))


def _whole_digits(x: Column) -> Column:
    """All digits of a whole double of 2 ** 40 or more, as it is in binary."""
    start = lambda: F.struct(F.lit(0).cast("long").alias("over"), F.array().cast("array<bigint>").alias("done"))

    def times(g: Column, by: Column) -> Column:
        add = lambda a, v: let(v * by + a["over"], lambda y: F.struct(_div(y).alias("over"), F.array_append(a["done"], y % GROUP).alias("done")))
        return F.aggregate(g, start(), add, lambda a: F.array_append(a["done"], a["over"]))

    def digits(x: Column, e: Column) -> Column:
        m = (x / F.pow(F.lit(2.0), e)).cast("long")  # whole: x has 53 binary digits at most
        powers = F.transform(F.sequence(F.lit(0), e, F.lit(STEP)), lambda k: F.pow(F.lit(2.0), F.least(F.lit(STEP), e - k)).cast("long"))
        groups = F.aggregate(powers, let(m, lambda m: F.array(m % GROUP, _div(m))), times)
        return F.regexp_replace(F.array_join(F.transform(F.reverse(groups), lambda g: F.lpad(g.cast("string"), 9, "0")), ""), "^0+", "")

    return let(x, lambda x: let(F.greatest(F.floor(F.log2(x)) - 54, F.lit(0)).cast("int"), lambda e: digits(x, e)))


def three_decimals(x: Column) -> Column:
    """At most three decimals and at least one, as text, of the double's exact value."""

    def parts(x: Column, floor: Column) -> Column:
        thousandths = lambda t: F.concat(_whole_digits(floor + F.floor(t / 1000)), F.lit("."), F.lpad((t % 1000).cast("int").cast("string"), 3, "0"))
        return let(F.rint((x - floor) * 1000), thousandths)  # exact from EXACT on

    exact = lambda x: let(F.when(x < float(1 << 53), F.floor(x).cast("double")).otherwise(x), lambda floor: parts(x, floor))
    text = lambda x: F.when(x == float("inf"), "inf").when(x < EXACT, F.replace(F.format_number(x, 3), F.lit(","), F.lit(""))).otherwise(exact(x))
    return F.regexp_replace(let(x, text), r"(\.\d*?[1-9]|\.0)0+$", "$1")


def _one_of(w: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(w).isin(words), F.lit(False))


def scaled_number(number: Column, before: Column, after: Column) -> Column:
    """K, M, B scaling with up to three decimals, signs of the words beside, quantity words.

    ``number`` is the digits as matched. Several dots, or what is no number, stay as they are.
    One million and one billion are 1.0M and 1.0B; a million or more millions are billions.
    """
    digits = F.regexp_replace(number, r"[^-?\p{Nd}./]", "")
    return let(F.struct(digits.alias("digits"), digits.try_cast("double").alias("x")), lambda d: _scaled(d["digits"], d["x"], before, after))


def _scaled(digits: Column, x: Column, before: Column, after: Column) -> Column:
    dots = F.length(digits) - F.length(F.replace(digits, F.lit("."), F.lit("")))
    whole = dots == 0
    sign = lambda w: reduce(lambda c, k: c.when(F.lower(w) == k, SIGNS[k]), SIGNS, F.when(F.lit(False), "")).otherwise("")
    signed, thousands, millions, billions = (_one_of(after, words) for words in (list(SIGNS), QUANTITIES[:2], QUANTITIES[2:4], QUANTITIES[4:]))
    below = lambda *steps: reduce(lambda c, s: c.when(x < s[0], s[1]), steps[1:-1], F.when(x < steps[0][0], steps[0][1])).otherwise(steps[-1])
    by = F.when(signed | billions, 1.0).when(thousands, below((1e3, 1.0), (1e6, 1e3), 1e6)).when(millions, below((1e3, 1.0), 1e3)).otherwise(below((1e3, 1.0), (1e6, 1e3), (1e9, 1e6), 1e9))
    unit = F.when(signed, sign(after)).when(billions, "B").when(thousands, below((1e3, "K"), (1e6, "M"), "B")).when(millions, below((1e3, "M"), "B")).otherwise(below((1e3, ""), (1e6, "K"), (1e9, "M"), "B"))
    value = F.concat(let(by, lambda by: F.when(whole & (by == 1.0), F.coalesce(digits.try_cast("decimal(38,0)").cast("string"), digits)).otherwise(three_decimals(x / by))), unit)
    return F.when((dots > 1) | x.isNull(), digits).otherwise(F.concat(sign(before), value))


def number_terms(t: Column, before: Column, after: Column) -> Column:
    """The terms of a letterless token that is no date: one, or none if it holds no number. A sign keeps it as it is."""
    found = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0))
    scaled = lambda joined: F.when(joined.contains("-"), F.array(joined)).otherwise(F.array(scaled_number(joined, before, after)))
    return F.when(letterless(t), let(found, lambda a: F.when(F.size(a) > 0, let(F.array_join(a, ""), scaled)).otherwise(F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
