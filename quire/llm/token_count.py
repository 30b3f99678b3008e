"""Token counts, with overlap resynchronisation for huge documents.

A document longer than ``chunk`` characters is cut into overlapping chunks,
which tasks encode independently. Each chunk reports, within its overlaps, the
token boundaries that are proven stable, with the number of tokens before each.
Two neighbours are spliced at the first boundary that both report.

A boundary is proven where the split pattern can't join the characters around
it, whatever else the text holds: before a blank, tab or line end that follows
something other than white space, and between letters, digits and other signs,
unless an apostrophe comes before a letter. The pattern looks ahead by one
character only and never behind, and merges never cross its splits; so the
tokens before such a boundary don't depend on what follows it, nor those after
it on what precedes it, and both chunks have there exactly the tokens of the
whole text. Texts without blanks, as Chinese or Thai, so have boundaries at
their punctuation and marks. Where an overlap has no boundary, the document is
encoded again with chunks and overlaps eight times as wide, until one chunk is
the whole text.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import arrow, cut, only

_BLANK = " \n\t\r"


@lru_cache(maxsize=1 << 16)
def _kind(ch: str) -> str:
    """L, N or S (other signs); B for blanks; empty for what isn't sure: other white space, and characters that aren't assigned or too new."""
    if ch in _BLANK:
        return "B"
    k = unicodedata.category(ch)
    if ch.isspace() or k in ("Cn", "Cs") or k[0] == "Z" or 0x2EBF0 <= ord(ch) <= 0x2EE5F:
        return ""
    return k[0] if k[0] in "LN" else "S"


def proven(text: str, first: int, last: int) -> list[int]:
    """Positions from ``first`` to ``last`` of proven boundaries (never the text's own ends)."""
    out = []
    a, b = max(first, 1), min(last, len(text) - 1)
    x = _kind(text[a - 1]) if a <= b else ""
    for p in range(a, b + 1):
        y = _kind(text[p])
        if x and y and x != y and x != "B" and not (y == "L" and text[p - 1] == "'"):
            out.append(p)
        x = y
    return out


def boundaries(text: str, path: str, zones: list[tuple[int, int]]) -> tuple[int, list[dict[int, int]]]:
    """Number of tokens, and for each zone the proven token boundaries with the number of tokens before them."""
    ids = tokens.encode(text, path)
    ends = np.cumsum(tokens.byte_lengths(path)[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
    out = []
    for a, b in zones:
        at = proven(text, a, b)
        found = {}
        if at:
            where = np.cumsum([len(text[: at[0]].encode())] + [len(text[p:q].encode()) for p, q in zip(at, at[1:])])
            k = np.searchsorted(ends, where)
            for p, w, i in zip(at, where.tolist(), k.tolist()):
                if i < len(ends) and ends[i] == w:
                    found[p] = i + 1
        out.append(found)
    return len(ids), out


def chunks(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of chunks of ``chunk`` characters and ``overlap`` more."""
    if len(text) <= chunk + overlap:
        return [(0, text)]
    return [(s, text[s : s + chunk + overlap]) for s in range(0, max(1, len(text) - overlap), chunk)]


def splice(parts: list[tuple[int, int, dict[int, int], dict[int, int]]]) -> int | None:
    """Tokens of the whole from (start, tokens, head, tail) of each chunk in order; None if a junction has no common boundary."""
    total, begun = 0, 0
    for k, (start, n, _, tail) in enumerate(parts):
        if k + 1 == len(parts):
            return total + n - begun
        nxt, _, head, _ = parts[k + 1]
        common = {start + p: i for p, i in tail.items()}
        other = {nxt + p: i for p, i in head.items()}
        both = sorted(common.keys() & other.keys())
        both = [p for p in both if common[p] >= begun]
        if not both:
            return None
        total += common[both[0]] - begun
        begun = other[both[0]]
    return total


def count_text(text: str, path: str = tokens.RANKS, chunk: int = 32768, overlap: int = 512) -> int:
    """The same for one text in one place."""
    while True:
        parts = []
        pieces = chunks(text, chunk, overlap)
        for k, (s, t) in enumerate(pieces):
            n, (head, tail) = boundaries(t, path, [(0, overlap) if k else (1, 0), (chunk, chunk + overlap) if k + 1 < len(pieces) else (1, 0)])
            parts.append((s, n, head, tail))
        total = splice(parts)
        if total is not None:
            return total
        chunk, overlap = chunk * 8, overlap * 8


def _round(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(id, k1, k2, n, n_tokens or null, n_chunks, times) of documents (id, k1, k2, text)."""

    def slices(batches):
        for b in batches:
            ids, k1, k2, texts = b.columns
            for r in range(b.num_rows):
                for k, (s, t) in enumerate(pieces := chunks(texts[r].as_py(), chunk, overlap)):
                    yield pa.RecordBatch.from_arrays([ids.slice(r, 1), k1.slice(r, 1), k2.slice(r, 1), pa.array([k], pa.int32()), pa.array([len(pieces)], pa.int32()), pa.array([s], pa.int64()), pa.array([t], pa.string())], names=["id", "k1", "k2", "k", "of", "start", "text"])

    def encoded(batches):
        for b in batches:
            k, of, text = (b.column(i).to_pylist() for i in (3, 4, 6))
            rows = [boundaries(t, path, [(0, overlap) if i else (1, 0), (chunk, chunk + overlap) if i + 1 < m else (1, 0)]) for i, m, t in zip(k, of, text)]
            lists = [pa.array([list(v) for v in vs], pa.list_(pa.int64())) for vs in ([r[1][0].keys() for r in rows], [r[1][0].values() for r in rows], [r[1][1].keys() for r in rows], [r[1][1].values() for r in rows])]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in (0, 1, 2, 3, 4, 5)], pa.array([r[0] for r in rows], pa.int64()), *lists], names=["id", "k1", "k2", "k", "of", "start", "n", "hp", "hn", "tp", "tn"])

    def joined(key, pdf: pd.DataFrame) -> pd.DataFrame:
        times = int(pdf.loc[pdf["k"] == 0, "times"].sum())
        pdf = pdf.sort_values("k")
        zip_ = lambda a, b: dict(zip(map(int, a), map(int, b)))
        total = splice([(int(r.start), int(r.n), zip_(r.hp, r.hn), zip_(r.tp, r.tn)) for r in pdf.itertuples()])
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "k1": [key[1]], "k2": [key[2]], "n_tokens": pd.array([total], "Int64"), "n_chunks": [len(pdf)], "times": [times]})

    kind = docs.schema["id"].dataType.simpleString()
    cutup = docs.mapInArrow(slices, f"id {kind}, k1 bigint, k2 bigint, k int, of int, start bigint, text string")
    spread = cutup.repartition("k1", "k", F.spark_partition_id())  # copies of one text too
    enc = spread.mapInArrow(encoded, f"id {kind}, k1 bigint, k2 bigint, k int, of int, start bigint, n bigint, hp array<bigint>, hn array<bigint>, tp array<bigint>, tn array<bigint>")
    enc = enc.groupBy("id", "k1", "k2", "k", "start").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", "hp", "hn", "tp", "tn")])
    return enc.groupBy("id", "k1", "k2").applyInPandas(joined, f"id {kind}, k1 bigint, k2 bigint, n_tokens bigint, n_chunks int, times int")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = tokens.RANKS, chunk: int = 32768, overlap: int = 512) -> DataFrame:
    """(doc_id, n_tokens, n_chunks) for each row of the documents.

    Equal to encoding each text as a whole. Null and empty texts have 0 tokens
    in 0 chunks. Rows that repeat an id are counted one by one. An empty table
    gives an empty one. Other columns are left behind, whatever they are called.
    """
    d = only(docs, id_col, text_col).toDF("id", "text")
    huge = F.length("text") > chunk + overlap
    count = arrow(lambda a: pa.array(tokens.counts(a, path)), "bigint")
    small = d.where(~F.coalesce(huge, F.lit(False))).select(F.col("id").alias("doc_id"), count(F.col("text")).alias("n_tokens"), F.when(F.length("text") > 0, 1).otherwise(0).alias("n_chunks"))
    todo = d.where(huge).select("id", F.xxhash64("text").alias("k1"), F.hash("text").cast("bigint").alias("k2"), "text")
    out = small
    while True:
        done, _ = cut(_round(todo, path, chunk, overlap))
        good = done.where("n_tokens is not null")
        out = out.unionByName(good.select(F.col("id").alias("doc_id"), "n_tokens", "n_chunks", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("t")).drop("t"))
        bad = done.where("n_tokens is null")
        if bad.isEmpty():
            return out
        keys = bad.select("k1", "k2", "id")
        todo = todo.alias("t").join(keys.alias("b"), (F.col("t.k1") == F.col("b.k1")) & (F.col("t.k2") == F.col("b.k2")) & F.col("t.id").eqNullSafe(F.col("b.id")), "left_semi")
        chunk, overlap = chunk * 8, overlap * 8
