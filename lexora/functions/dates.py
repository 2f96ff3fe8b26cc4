"""Times of posts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def post_time(c: Column) -> Column:
    """'Wed Jul 22 12:20:42 +0000 2020' as a timestamp; anything else is null."""
    return F.try_to_timestamp(F.substr(c, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def age_minutes(created_at: Column, as_of: Column) -> Column:
    return F.timestamp_diff("MINUTE", created_at, as_of)
