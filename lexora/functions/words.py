"""Fixed word lists and patterns of the text rules."""

from __future__ import annotations

# The public English stop list.
ENGLISH = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain
aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't
mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Marks and words of short posts that carry no meaning. They must match the engine's
# whose results these are, so each entry stands once, in the order of its first
# mention there; "}'&'" is one entry there too.
POST_MARKS = [
    "RT", "http", "https", "", "'", "''", '"', "``", "’", "...", "…", "twitter.com", "web", "status", "i", "n't", "--", "'re", "..", "'it", "'m",
    "......", ".....", "//", "'ve", "N'T", "'ll", "S", "s", " ", "‘", "`", '""', "“", "”",
    "rt", "!", "?", ",", ":", ";", "(", ")", "[", "]", "{", "}'&'", "$",
    ".", "\\'s", "'s", "'d", "\\'d", "n\\'t", "1️⃣.1️⃣2️⃣", "~~",
]

# Never indexed, whatever produced them.
SKIPPED = ["twitter.com", "web", "status", "i"]

STOP_WORDS = sorted({*ENGLISH, *POST_MARKS})

# Currency and percent words, and quantity words.
SIGNS = {"usd": "$", "aud": "$", "eur": "€", "$": "$", "€": "€", "£": "£", "percent": "%", "percentage": "%", "%": "%"}
QUANTITIES = ["thousand", "thousands", "million", "millions", "billion", "billions"]

# Patterns, as Java writes them.
NUMBER = r"[-+]?\p{Nd}+(?:\.\p{Nd}+)?/[-+]?\p{Nd}+(?:\.\p{Nd}+)?\w?[k|KmMbB]?|[-+]?[.]?\p{Nd}+(?:,\p{Nd}\p{Nd}\p{Nd})*[.]?\p{Nd}*(?:[eE][-+]?\p{Nd}+)?[k|KmMbB]?"
DATE = r"\p{Nd}{1,4}[-./]\p{Nd}{1,4}"
URL_FIRST = r"https?://\S+"
URL_IN_QUERY = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
URL_PIECE = r"(?U)[\w'|.-]+"
KEPT_LETTERS = r"[^\x00-\x7F\x80-\xFFĀ-ɏḀ-ỿ’]"
EMOJI = r"^[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}〰✂-➰️\x{1F1E0}-\x{1F1FF}♀-♂‍─-⯯\x{10000}-\x{10FFFF}Ⓜ-\x{1F251}⏏⏩⌚☀-⭕]"
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
