"""Token ids of texts by a public byte-level BPE vocabulary, named by its path."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

BLANK_RUN = re.compile(r"\s{20000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _slow(path: str, plain: bool):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


@lru_cache(maxsize=2)
def special_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary as merge ranks: in these files an id is its rank."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    special = {t["content"] for t in j["added_tokens"]}
    of = _byte_of()
    ranks = {bytes(of[c] for c in t): i for t, i in j["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(text: str, path: str, plain: bool = False) -> list[int]:
    """Ids of the whole text, those of the tokenizers library; with ``plain``, strings of special tokens are ordinary text.

    A text that holds such a string, or a very long run of blanks, which overflows the fast
    tokenizer's matcher, takes the library; all others have the same ids by the fast one.
    """
    if (not plain and any(s in text for s in special_tokens(path))) or (len(text) >= 20000 and BLANK_RUN.search(text)):
        return _slow(path, plain).encode(text, add_special_tokens=False).ids
    return _fast(path).encode_ordinary(text)


def id_array(text: str, path: str, end: int) -> np.ndarray:
    """Little-endian uint32 ids of the text, then the end id."""
    out = ids(text, path)
    out.append(end)
    return np.array(out, "<u4")
