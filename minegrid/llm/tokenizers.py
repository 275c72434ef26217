"""The public byte-level BPE, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import regex

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where the installed vocabulary lies; a path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encodes text piece by piece (a piece: what the splitting pattern yields; tokens never cross pieces)."""

    def __init__(self, path: str, remember: int = 200_000) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, tuple[int, ...]] = {}
        self.remember = remember

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.known.get(text)
        if ids is None:
            # a lone surrogate can't be encoded in UTF-8; it counts as the replacement character
            ids = tuple(self.encoding.encode_ordinary(text))
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids of a text; special tokens' names are ordinary text."""
        return self.encoding.encode_ordinary(text)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)
