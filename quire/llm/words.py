"""Vectorised word splitting and hashing over Arrow string buffers.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, but
for General Punctuation (U+2000-U+207F), the Latin-1 signs U+00A0-U+00BF and
CJK punctuation (U+3000-U+303F), which separate words as ASCII signs do.
Callers lower-case the text first (``F.lower``), inside the JVM.

Work is done on bytes, a few numpy passes for a whole batch, so that neither a
Python string nor a list is made for any word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = np.zeros(256, dtype=bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null row is empty."""
    if pa.types.is_dictionary(arr.type):
        arr = arr.dictionary_decode()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]] if len(o) else b, (o - o[0] if len(o) else np.zeros(1, np.int64))


def runs(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def split(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and for each row the number of the first."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = _WORD[buf]
    nxt = np.empty(n, np.uint8)
    nxt[:-1], nxt[-1] = buf[1:], 0
    three = np.flatnonzero(((buf == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((buf == 0xE3) & (nxt == 0x80)))
    two = np.flatnonzero((buf == 0xC2) & (nxt < 0xC0))
    for at, k in ((three, 3), (two, 2)):
        for d in range(k if len(at) else 0):
            w[np.minimum(at + d, n - 1)] = False
    before = np.zeros(n + 1, bool)
    before[1:] = w
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(w & (~before[:-1] | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a step."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    view = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lens = ends - starts
    h = lens.astype(np.uint64) * _GOLD
    on = np.arange(len(starts))
    off = 0
    while len(on):
        left = np.minimum(lens[on] - off, 8)
        h[on] = mix64((h[on] + _GOLD) ^ (view[starts[on] + off] & _MASK[left]))
        off += 8
        on = on[lens[on] > off]
    return h


def hashed(arr: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, first word of each row and the end) for runs of rows."""
    buf, offs = raw(arr)
    for i, j in runs(offs, limit):
        b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        s, e, first = split(b, o)
        yield i, j, hashes(b, s, e), first


def plain(text: str | None) -> list[bytes]:
    """The same words one by one, for tests."""
    import re

    t = re.sub(r"[ -ⁿ\u0080-¿　-〿]", " ", (text or "").lower())
    return re.findall(rb"[0-9a-z\x80-\xff]+", t.encode())
