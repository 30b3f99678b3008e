"""Byte-level BPE of a public vocabulary file, loaded once in each Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    e = encoding(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.n_vocab)], np.int64)


def encode(text: str, path: str = RANKS) -> list[int]:
    """Ids of a text; strings of special tokens are ordinary text."""
    return encoding(path).encode_ordinary(text)


def counts(arr: pa.Array, path: str = RANKS) -> np.ndarray:
    """Number of tokens of each text, 0 for null."""
    f = encoding(path).encode_ordinary
    return np.fromiter((len(f(t.as_py())) if t.is_valid else 0 for t in arr), np.int64, len(arr))
