"""Token ids of whole texts for a byte-level BPE."""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers

FILE, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
LONG = 100_000  # blanks in a row, from which on the rank-file encoder may run out of stack
LONG_RUN = re.compile(rf"\s{{{LONG}}}")


class Encoder:
    """Ids as the ``tokenizers`` library gives them for ``FILE``.

    The same vocabulary as ranks gives the same ids several times faster; only texts with the special string, which the
    library reads as one token, and texts with a very long run of blanks go to the library itself. Tests hold the two against each other.
    """

    def __init__(self, path: str, ranks_path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if SPECIAL in text or len(text) >= LONG and LONG_RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.ranked.encode_ordinary(text), "<u4")


@cache
def encoder(path: str | None = None, ranks_path: str | None = None) -> Encoder:
    return Encoder(path or public_tokenizers.path(FILE), ranks_path or public_tokenizers.path(RANKS))
