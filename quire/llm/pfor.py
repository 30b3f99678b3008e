"""Token ids as patched frame-of-reference blocks.

A document's ids are cut into blocks of 128. Of each block the minimum is
subtracted, the rest is packed with as many bits as the 90th percentile of the
block needs, and the high bits of larger values go into an exception list. The
payload of a document is its blocks end to end; ``block_starts`` has the byte
where each begins, so any block can be read alone.

A block, little-endian: minimum (4 bytes), number of ids less one (1), width
(1), number of exceptions (1), packed low bits (ceil(ids * width / 8)),
positions of the exceptions (1 each), their high bits (4 each).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import arrow, only

BLOCK, HEAD, PERCENTILE = 128, 7, 90
KIND = "struct<n:int,starts:array<int>,data:binary>"


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all blocks end to end, where each begins (and the end), and each row's first block (and the end)."""
    per = -(-lengths // BLOCK)
    first = np.r_[0, np.cumsum(per)]
    nb = int(first[-1])
    if nb == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), first
    row_start = np.cumsum(lengths) - lengths
    inside = (np.arange(nb) - np.repeat(first[:-1], per)) * BLOCK
    begin = np.repeat(row_start, per) + inside
    size = np.minimum(np.repeat(lengths, per) - inside, BLOCK)
    at = begin[:, None] + np.arange(BLOCK)[None, :]
    real = np.arange(BLOCK)[None, :] < size[:, None]
    v = ids[np.minimum(at, len(ids) - 1)].astype(np.uint32)
    v = np.where(real, v, v[:, :1])
    low = v.min(axis=1)
    v -= low[:, None]
    v[~real] = 0
    rank = BLOCK - size + np.minimum((size * PERCENTILE + 99) // 100, size) - 1  # padding zeros sort first
    width = _bits(np.take_along_axis(np.sort(v, axis=1), rank[:, None], axis=1)[:, 0])
    out_of = (v >> width[:, None].astype(np.uint32)) > 0
    n_exc = out_of.sum(axis=1)
    packed = (size * width + 7) // 8
    start = np.r_[0, np.cumsum(HEAD + packed + 5 * n_exc)]
    out = np.zeros(int(start[-1]), np.uint8)
    head = np.zeros((nb, HEAD), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5], head[:, 6] = size - 1, width, n_exc
    out[start[:-1, None] + np.arange(HEAD)[None, :]] = head
    for w in np.unique(width):
        if w == 0:
            continue
        w = int(w)
        k = np.flatnonzero(width == w)
        for s in range(0, len(k), 4096):
            kk = k[s : s + 4096]
            b = np.unpackbits(v[kk].astype("<u4").view(np.uint8).reshape(len(kk), BLOCK, 4), axis=2, bitorder="little", count=w)
            bytes_ = np.packbits(b.reshape(len(kk), BLOCK * w), axis=1, bitorder="little")
            full = packed[kk] == bytes_.shape[1]
            out[(start[kk[full]] + HEAD)[:, None] + np.arange(bytes_.shape[1])[None, :]] = bytes_[full]
            for i in np.flatnonzero(~full):
                n, p = int(packed[kk[i]]), int(start[kk[i]]) + HEAD
                out[p : p + n] = bytes_[i, :n]
    b, p = np.nonzero(out_of)
    if len(b):
        nth = np.arange(len(b)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        base = start[b] + HEAD + packed[b]
        out[base + nth] = p
        high = (v[b, p] >> width[b].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_exc[b] + 4 * nth)[:, None] + np.arange(4)[None, :]] = high
    return out, start, first


def decode_block(data: bytes, start: int) -> np.ndarray:
    """Ids of the block that begins at ``start``."""
    low = int.from_bytes(data[start : start + 4], "little")
    n, w, e = data[start + 4] + 1, data[start + 5], data[start + 6]
    p = start + HEAD
    size = (n * w + 7) // 8
    v = np.zeros(n, np.int64)
    if w:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, p), bitorder="little")[: n * w].reshape(n, w)
        v = bits.astype(np.int64) @ (1 << np.arange(w, dtype=np.int64))
    where = np.frombuffer(data, np.uint8, e, p + size)
    v[where] += np.frombuffer(data, "<u4", e, p + size + e).astype(np.int64) << w
    return v + low


def decode(data: bytes, starts: list[int]) -> np.ndarray:
    """All ids of a payload."""
    return np.concatenate([decode_block(data, s) for s in starts]) if len(starts) else np.zeros(0, np.int64)


def _column(path: str):
    def some(texts):
        e = tokens.encoding(path)
        parts = [e.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        data, start, first = encode(ids, lengths)
        inside = (start[:-1] - np.repeat(start[first[:-1]], np.diff(first))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(inside))
        binary = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(start[first].astype(np.int32)), pa.py_buffer(data)])
        return pa.StructArray.from_arrays([pa.array(lengths.astype(np.int32)), lists, binary], names=["n", "starts", "data"])

    def run(arr: pa.Array) -> pa.Array:
        parts, i = [], 0
        while i < len(arr):
            texts, size = [], 0
            while i < len(arr) and (not texts or size < 2 << 20):
                texts.append(arr[i].as_py())
                size += len(texts[-1] or "")
                i += 1
            parts.append(some(texts))
        return pa.concat_arrays(parts) if parts else some([])

    return run


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = tokens.RANKS) -> DataFrame:
    """(doc_id, n_tokens, block_starts, payload) of each row of the documents.

    Null and empty texts have no tokens, no block and an empty payload. Rows
    that repeat an id are written one by one; an empty table gives an empty
    one. No shuffle: a document's payload is made where its text is read.
    """
    d = only(docs, id_col, text_col).toDF("doc_id", "text")
    d = d.select("doc_id", arrow(_column(path), KIND)(F.col("text")).alias("b"))
    return d.select("doc_id", F.col("b.n").alias("n_tokens"), F.col("b.starts").alias("block_starts"), F.col("b.data").alias("payload"))
