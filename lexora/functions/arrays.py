"""Counting inside a row: an array is sorted and its runs of equal values are told apart, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that is computed once a row, however often later steps use it (within a lambda, once an element otherwise)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, f) -> Column:
    """f(value), of a value that is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def run_starts(sorted_column: str, value=lambda x: x) -> Column:
    """The places in a sorted array, held(), where another value begins."""
    a = F.col(sorted_column)
    places = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (value(F.get(a, i)) != value(F.get(a, i - 1))))


def runs(sorted_column: str, starts: str, value=lambda x: x, item=None) -> Column:
    """(term, from, tf) of each run of a sorted array, given its run_starts(); both held(). And ``items``, item(x) of each of a run's elements, if asked."""
    a, n = F.col(sorted_column), F.size(sorted_column)
    end = lambda k: F.coalesce(F.get(F.col(starts), k + 1), n)
    items = lambda s, k: [F.transform(F.sequence(s, end(k) - 1), lambda i: item(F.get(a, i))).alias("items")] if item else []
    return F.transform(starts, lambda s, k: F.struct(value(F.get(a, s)).alias("term"), s.alias("from"), (end(k) - s).alias("tf"), *items(s, k)))
