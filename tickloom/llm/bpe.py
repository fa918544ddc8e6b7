"""Token ids of a public byte-level BPE, through a cache of words.

`tokenizers` defines the ids. A text whose only white space is single blanks and line ends splits before each of them
into units that the tokenizer never joins, so a unit's ids can be kept. A unit that is not kept yet is encoded by
`tiktoken` on the same vocabulary where it holds only Latin letters, and by `tokenizers` otherwise; so is any text with
other white space or the special token.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

END = 50256
_ODD = re.compile(r"\s\s|[^\S \n]|[\x1c-\x1f\x85]")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_SPECIAL = "<|endoftext|>"


class WordCache(dict):
    """Units to their ids as little-endian uint16 bytes; cleared when it is full, so memory stays bounded."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[unit] = out = self.encode(unit)
        return out


class Encoder:
    """Texts to uint16 ids. literal_specials: the special token's string in a text is ordinary text."""

    def __init__(self, json_path: str, ranks_path: str, literal_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.encode_special_tokens = literal_specials
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache = WordCache(self._unit)

    def _by_tokenizers(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _unit(self, unit: str) -> bytes:
        if _BEYOND_LATIN.search(unit):
            return self._by_tokenizers(unit)
        return np.array(self.words.encode_ordinary(unit), "<u2").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if _SPECIAL in text or "\0" in text or _ODD.search(text):  # NUL marks the cuts below
            return np.frombuffer(self._by_tokenizers(text), "<u2")
        units = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return np.frombuffer(b"".join(map(self.cache.__getitem__, units)), "<u2")


_made: dict[tuple, Encoder] = {}


def encoder(json_path: str, ranks_path: str, literal_specials: bool = False) -> Encoder:
    """One encoder for each Python worker."""
    key = (json_path, ranks_path, literal_specials)
    if key not in _made:
        _made[key] = Encoder(*key)
    return _made[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
