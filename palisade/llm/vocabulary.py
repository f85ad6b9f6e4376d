"""Public vocabularies, loaded once in each Python worker. Paths are parameters; no file is copied."""

from __future__ import annotations

import base64
from functools import lru_cache


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def public(name: str) -> str:
    """The place of a vocabulary file of the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def rank_encoding(path: str):
    """A tiktoken encoding of a rank file, with the package's pattern and no special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(2)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
