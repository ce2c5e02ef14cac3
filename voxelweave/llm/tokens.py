"""Token ids of a public byte-level BPE, by its fast form where both forms agree."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Texts in these characters split alike in both libraries; anything else, and any text with a special
#: token's name in it, goes through ``tokenizers`` itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """Loaded only where a text needs it: the vocabulary takes tens of MB in every worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids (no special tokens added), for a ``tokenizers`` file.

    If the same vocabulary lies beside it as ranks (``.tiktoken``), plain texts use that: several times as
    fast, the same ids (tests compare them).
    """
    exact = lambda text: np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if "<|" in text or not PLAIN.fullmatch(text):
            return exact(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode
