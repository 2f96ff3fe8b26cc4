"""URLs of a post: which it holds, and which domains they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import capital_form, is_alpha
from .words import SKIPPED, URL_FIRST, URL_PIECE

MAP = "map<string,string>"


def url_map(json: Column) -> Column:
    """A short-to-long URL object; malformed text gives null."""
    return F.from_json(json, MAP)


def map_urls(json: Column) -> Column:
    """Each entry's long URL, or its key where that is null."""
    return F.coalesce(F.transform(F.map_entries(url_map(json)), lambda e: F.coalesce(e["value"], e["key"])), F.array().cast("array<string>"))


def post_urls(text: Column, urls: Column, *more: Column) -> Column:
    """Distinct URLs of a post: of its maps, and the text's first if its own map is {}."""
    first = F.regexp_extract(text, URL_FIRST, 0)
    own = F.when((urls == "{}") & (first != ""), F.array(first)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), *[map_urls(u) for u in (urls, *more)]))


def domain_terms(urls: Column) -> Column:
    """The part after www. of each URL that has one: alphabetic ones in capital form, skipped words left out."""
    pieces = F.flatten(F.transform(urls, lambda u: F.filter(F.regexp_extract_all(u, F.lit(URL_PIECE), F.lit(0)), lambda p: p.contains("www."))))
    parts = F.filter(F.transform(pieces, lambda p: F.get(F.split(p, r"\."), F.lit(1))), lambda d: d.isNotNull() & (d != "") & ~d.contains("http") & ~d.isin(SKIPPED))
    return F.transform(parts, lambda d: F.when(is_alpha(d), capital_form(d)).otherwise(d))


def concat_post(text: Column, retweet_quoted: Column, quoted: Column, retweet: Column | None = None) -> Column:
    """The text, the quoted text of what it repeats, and its own quoted text if that differs; optionally the repeated text."""
    parts = [text, retweet_quoted, F.when(~quoted.eqNullSafe(retweet_quoted), quoted)]
    return F.concat_ws(" ", *parts, *([retweet] if retweet is not None else []))


def int_list(c: Column) -> Column:
    """'[174,203]' as integers; null or empty text as an empty list."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
