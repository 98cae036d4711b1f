"""Sizes in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Where the vocabulary lies by default; the environment may name another file.
VOCABULARY = os.environ.get("TOKENIZER_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how byte-level BPE of this family cuts a text into words before it merges bytes.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in parts that end where a word does.  Only a single word above this length is itself cut: merging its bytes takes time
#: that grows faster than its length.
LONGEST = 100_000


@lru_cache(4)
def tokenizer(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def token_bytes(path: str = VOCABULARY) -> np.ndarray:
    """Length in bytes of each token."""
    e = tokenizer(path)
    out = np.zeros(e.max_token_value + 1, np.int64)
    for token, rank in e._mergeable_ranks.items():
        out[rank] = len(token)
    return out


def encode(text: str, path: str = VOCABULARY) -> np.ndarray:
    e = tokenizer(path)
    if len(text) <= LONGEST:
        return np.array(e.encode_ordinary(text), np.int64)
    return np.concatenate([np.array(e.encode_ordinary(text[a:b]), np.int64) for a, b in parts(text)])


def parts(text: str, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of at most ``longest`` characters, cut only where the tokenizer's own words end."""
    begin = end = 0
    for m in _words().finditer(text):
        if m.end() - begin > longest and end > begin:
            yield begin, end
            begin = end
        while m.end() - begin > longest:  # one word
            yield begin, begin + longest
            begin += longest
        end = m.end()
    if end > begin:
        yield begin, end


@lru_cache(1)
def _words():
    import regex

    return regex.compile(WORDS)


def count(text: str | None, path: str = VOCABULARY) -> int:
    return len(encode(text, path)) if text else 0
