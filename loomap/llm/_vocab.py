"""Vocabulary files of public tokenizers; their folder is a parameter and nothing is copied from it."""

from __future__ import annotations

import base64
import functools

TOKENIZERS = "/opt/tokenizers"
#: Splits a text into pieces that are encoded by themselves: contractions, words, numbers, other characters, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def ranks(name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> dict[bytes, int]:
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def encoding(name: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})
