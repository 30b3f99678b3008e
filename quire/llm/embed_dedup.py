"""Embedding near-duplicate removal: sign hashing in several tables, exact cosines, connected components.

A table hashes a vector by the signs of its products with random hyperplanes;
two vectors at angle t agree in one sign with probability 1 - t / pi. Pairs
that share a bucket of any table are verified by their exact cosine. Buckets
hold about ``BUCKET`` vectors of spread-out data, so the number of signs grows
with the logarithm of the table's size, and the number of tables is chosen
such that a pair at the threshold is found with probability ``recall``.

What travels to the buckets is a vector in bytes: its direction, each element
rounded to 8 bits, with the length of the rounding error. That bounds how far
the product of two roundings can be from their cosine, so nearly all pairs are
decided where they meet; the few whose bounds hold the threshold between them
are settled by the vectors themselves. A bucket returns the links of a
spanning forest, not all pairs of a group of copies.

A bucket of any size is verified completely: one of more than ``BLOCK`` vectors
is cut into blocks and each pair of blocks is a unit of its own, so hot buckets
spread over tasks and memory is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .shared import Frame, arrow, cut, drop
from .simhash import _Forest

BUCKET, BLOCK = 256, 4096


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs a table, tables)."""
    bits = min(48, max(1, math.ceil(math.log2(max(1, n) / BUCKET))))
    p = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def planes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count)).astype(np.float32)


def _by_width(arr: pa.Array):
    """(rows, matrix) for each width of the vectors."""
    arr = arr.cast(pa.list_(pa.float32()))
    n = np.diff(arr.offsets.to_numpy())
    flat = arr.values.to_numpy(zero_copy_only=False)
    at = arr.offsets.to_numpy()[:-1]
    for d in np.unique(n):
        rows = np.flatnonzero(n == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)[None, :]]


CODED = "struct<codes:array<bigint>,q:binary,s:float,e:float>"
KEY = ("tab", "code", "dim", "x", "y")


def coded(bits: int, tables: int, seed: int):
    """Codes of a vector in all tables, its direction in bytes ``q`` of size ``s``, and the length ``e`` of what rounding took."""

    def run(arr: pa.Array) -> pa.Array:
        n = len(arr)
        out, size, error = np.zeros((n, tables), np.int64), np.zeros(n, np.float32), np.zeros(n, np.float32)
        q: list[bytes] = [b""] * n
        for rows, x in _by_width(arr):
            z = x @ planes(x.shape[1], bits * tables, seed) > 0
            out[rows] = z.reshape(len(rows), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            u = x.astype(np.float64)
            u /= np.abs(u).max(axis=1, keepdims=True)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            s = (np.abs(u).max(axis=1) / 127).astype(np.float32)
            r = np.rint(u / s[:, None]).clip(-127, 127).astype(np.int8)
            size[rows] = s
            error[rows] = np.linalg.norm(u - r * s[:, None].astype(np.float64), axis=1) + 1e-6
            for k, i in enumerate(rows.tolist()):
                q[i] = r[k].tobytes()
        codes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(out.ravel()))
        return pa.StructArray.from_arrays([codes, pa.array(q, pa.binary()), pa.array(size), pa.array(error)], names=["codes", "q", "s", "e"])

    return run


def _verify(threshold: float, every: bool):
    def unit(t: pa.Table, s: int, e: int, dim: int, split: bool):
        """(a, b, sure) of one pair of blocks: rows s to e, all of one key."""
        vid = t["vid"].to_numpy()[s:e]
        m = np.frombuffer(b"".join(t["q"].slice(s, e - s).to_pylist()), np.int8).reshape(e - s, dim).astype(np.float32 if dim <= 1024 else np.float64)
        size, err = (t[c].to_numpy()[s:e].astype(np.float64) for c in ("s", "e"))
        first = t["first"].to_numpy()[s:e]
        p, q = (np.flatnonzero(first), np.flatnonzero(~first)) if split else (np.arange(e - s),) * 2
        found = []
        for i in range(0, len(p), 512):
            k = p[i : i + 512]
            c = (m[k] @ m[q].T) * size[k][:, None] * size[q][None, :]
            slack = err[k][:, None] * (1 + err[q][None, :]) + err[q][None, :] * (1 + err[k][:, None]) + err[k][:, None] * err[q][None, :]
            a, b = np.nonzero(c + slack >= threshold)
            a_, b_ = k[a], q[b]
            on = slice(None) if split else a_ < b_
            found.append((a_[on], b_[on], (c - slack >= threshold)[a, b][on]))
        a, b, sure = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        if not every:
            forest = _Forest(e - s)
            forest.add(a[sure], b[sure])
            open_ = ~sure & (forest.label[a] != forest.label[b])
            child = np.flatnonzero(forest.label != np.arange(e - s))
            a, b, sure = np.r_[child, a[open_]], np.r_[forest.label[child], b[open_]], np.r_[np.ones(len(child), bool), np.zeros(int(open_.sum()), bool)]
        return vid[a], vid[b], sure

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t[c].to_numpy() for c in KEY], axis=1)
        at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        got = [unit(t, s, e, int(key[s, 2]), key[s, 3] != key[s, 4]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        a, b, sure = (np.concatenate(z) for z in zip(*got))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], names=["a", "b", "sure"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            tail = np.ones(held.num_rows, bool)
            for c in KEY:
                v = held[c].to_numpy()
                tail &= v == v[-1]
            k = int(np.flatnonzero(tail)[0])
            if k:
                yield pairs(held.slice(0, k).combine_chunks())
                held = held.slice(k).combine_chunks()
        if held is not None:
            yield pairs(held.combine_chunks())

    return run


def links(vectors: DataFrame, threshold: float, recall: float, every: bool = False, seed: int = 7) -> DataFrame:
    """(a, b) of ``vid`` for distinct vectors (vid, v): links that join all found pairs at ``threshold`` or above, or with ``every`` these pairs all, a < b."""
    bits, tables = tables_for(vectors.count(), threshold, recall)
    d = vectors.select("vid", F.size("v").alias("dim"), arrow(coded(bits, tables, seed), CODED)(F.col("v")).alias("c")).select("vid", "dim", "c.*")
    d, path = cut(d)
    each = F.posexplode("codes").alias("tab", "code")
    hot = d.select("dim", each).groupBy("tab", "code", "dim").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("tab", "code", "dim", F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)").alias("of"))
    e = d.select("vid", "dim", "q", "s", "e", each).join(hot, ["tab", "code", "dim"], "left").withColumn("of", F.coalesce("of", F.lit(1)))
    e = e.withColumn("blk", F.expr("cast(pmod(xxhash64(vid), of) as int)")).withColumn("other", F.explode(F.expr("sequence(0, of - 1)")))
    e = e.select("tab", "code", "dim", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), (F.col("blk") < F.col("other")).alias("first"), "vid", "q", "s", "e")
    e = e.repartition(*KEY).sortWithinPartitions(*KEY)
    p, pairs_path = cut(e.mapInArrow(_verify(threshold, every), "a bigint, b bigint, sure boolean"))
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    doubt = p.where("not sure").select(*pair).distinct()
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    both = doubt.join(vectors.select(F.col("vid").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("vid").alias("b"), F.col("v").alias("vb")), "b")
    settled = both.where(dot / (norm(F.col("va")) * norm(F.col("vb"))) >= threshold).select("a", "b")
    out, _ = cut(p.where("sure").select(*pair).unionByName(settled).distinct())
    drop(d.sparkSession, path)
    drop(d.sparkSession, pairs_path)
    return out


def near_pairs(vectors: DataFrame, threshold: float, recall: float, seed: int = 7) -> DataFrame:
    """(a, b) of distinct vectors (h1, h2, v) at ``threshold`` or above, every pair of a group; a and b are structs (h1, h2), a < b."""
    v, _ = cut(vectors.select(F.monotonically_increasing_id().alias("vid"), "h1", "h2", "v"))
    name = lambda k: v.select(F.col("vid").alias(k), F.struct("h1", "h2").alias(f"{k}_"))
    p = links(v.select("vid", "v"), threshold, recall, True, seed).join(name("a"), "a").join(name("b"), "b")
    return p.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))


def dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.98) -> DataFrame:
    """Vectors left when one of each group of near copies stays: that of least id (nulls last).

    Groups are the components of the pairs whose cosine is ``threshold`` or
    more; equal vectors are always together. Vectors that are null, empty, of
    norm zero or with a null, NaN or infinite element have no direction and all
    stay, as groups of one; vectors of different lengths are never near. Rows
    that repeat id and vector are copies. Adds ``group_size``; an input column
    of that name gives way, all others stay whatever they are called. An empty
    table gives an empty one.
    """
    fr = Frame(table)
    v = fr[vector_col].cast("array<float>")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    fine = F.coalesce((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.lit(False))
    d = fr.df.select("*", v.alias("v"), fine.alias("fine"))
    good = d.where("fine").select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    rows = good.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min(fr[id_col]).alias("first"))
    distinct, _ = cut(rows.select(F.monotonically_increasing_id().alias("vid"), "h1", "h2", "v", "n", "first"))
    comp = components(links(distinct.select("vid", "v"), threshold, recall)).groupBy("node").agg(F.min("root").alias("root"))
    whole = distinct.select("vid", "h1", "h2", "n", "first").join(comp, F.col("vid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "vid"))
    best = whole.groupBy("root").agg(F.sum("n").alias("size"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "h1", "h2")).alias("s"))
    key = lambda i: (F.xxhash64(i, "h1", "h2").alias("k1"), F.xxhash64(F.lit(1), "h2", i.isNull(), i, "h1").alias("k2"))
    keep = best.select("s.first", "s.h1", "s.h2", "size").select(*key(F.col("first")), "size")
    again = W.partitionBy("k1", "k2").orderBy("h1")
    kept = good.select(*fr.df.columns, *key(fr[id_col]), "h1").withColumn("rn", F.row_number().over(again)).where("rn = 1").join(keep, ["k1", "k2"])
    out = kept.select(*fr.df.columns, "size").unionByName(d.where("not fine").select(*fr.df.columns, F.lit(1).cast("bigint").alias("size")))
    return fr.close(out, group_size=F.col("size"))


def sql(table: str = "embeddings", threshold: float = 0.95) -> str:
    """The same for DuckDB by comparing all pairs, for a table (vec_id, embedding, ...) of small size."""
    return f"""with recursive v as (select vec_id, embedding, cast(embedding as double[]) as e from {table} where list_aggregate(list_transform(embedding, lambda x: x * x), 'sum') > 0),
    l as (select a.vec_id as x, b.vec_id as y from v a join v b on len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {threshold}),
    r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
    g as (select x, min(y) as least, count(*) as n from r group by x)
    select t.*, coalesce(g.n, 1) as group_size from {table} t left join g on t.vec_id = g.x where g.x is null or g.least = t.vec_id"""
