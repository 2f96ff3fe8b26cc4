"""Schema of a corpus of posts."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fields of a post, in the order of its columns.
POST_FIELDS = ["post_id", "created", "full_text", "urls", "indices", "retweet_text", "retweet_urls", "retweet_indices", "quoted_text", "quote_urls", "quoted_indices", "retweet_quoted_text", "retweet_quoted_urls", "retweet_quoted_indices"]
POST = T.StructType([T.StructField(n, T.StringType(), n not in ("post_id", "created", "full_text")) for n in POST_FIELDS])
