"""SimHash near-duplicate removal by a self-join of binary tries.

A document's fingerprint is the 128-bit SimHash of its set of distinct words.
Two documents are near copies if their fingerprints differ in at most
``budget`` bits (18 by default, that is an angle of about 25 degrees between
word sets; on the synthetic corpus copies with 3 to 7 percent of their words
changed differ by 3 to 18 bits in 98 of 100 pairs, and documents that share
passages only by 19 or more, nearly all by more than 30).

The join is exact. A fingerprint is cut into blocks, each with a bound of its
own such that the bounds and one more a block sum up to ``budget + 1``; two
fingerprints within ``budget`` bits are then within the bound of one block at
least. For each block, a trie whose first levels are that block is joined with
itself: pairs of nodes are walked together from the root, every level adds the
bits in which they differ, and a pair is dropped when it exceeds the block's
bound or the whole budget. Pairs of small subtrees are compared leaf by leaf.
The number of blocks follows from the number of fingerprints: the more there
are, the wider the blocks, so that the pairs to compare stay far from the
square of the corpus.

Tries are spread over tasks by pairs of nodes some levels down whose prefixes
are within the block's bound. The depth is such that no node holds more than
``trie_size`` fingerprints and there are tasks for all cores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import Frame, arrow, cut, drop

BITS = 128
#: Bits of the filter that tells which rows may be in a group: a broadcast of 2**19 numbers at most.
FILTER_BITS = 25
_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.uint8)).copy().view("<u8").ravel()
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def _fingerprints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint64[n, 2], number of distinct words) of each text."""
    n = len(arr)
    out, sizes = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64)
    for i, j, h, first in words.hashed(arr):
        doc = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(first))
        key = np.sort((doc << np.uint64(44)) | (h >> np.uint64(20)))
        if not len(key):
            continue
        key = key[np.r_[True, key[1:] != key[:-1]]]
        d = (key >> np.uint64(44)).astype(np.int64)
        count = np.bincount(d, minlength=j - i)
        f = key & np.uint64((1 << 44) - 1)
        # counters of eight bits, eight to a machine word, over at most 255 words each
        rank = np.arange(len(d)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
        at = np.flatnonzero(rank % 255 == 0)
        owner = d[at]
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for k, seed in enumerate(_SEEDS):
            b = words.mix64(f ^ seed).view(np.uint8).reshape(-1, 8)
            bits = np.zeros((j - i, 64), np.int64)
            for byte in range(8):
                lanes = np.add.reduceat(_SPREAD[b[:, byte]], at).view(np.uint8).reshape(-1, 8)
                bits[owner[head], byte * 8 : byte * 8 + 8] = np.add.reduceat(lanes.astype(np.int64), head, axis=0)
            out[i:j, k] = np.packbits(bits * 2 > count[:, None], axis=1, bitorder="little").view("<u8").ravel()
        sizes[i:j] = count
    return out, sizes


def _fingerprint(text: pa.Array) -> pa.Array:
    fp, sizes = _fingerprints(text)
    none = sizes == 0
    cols = [pa.array(fp[:, k].view(np.int64)) for k in (0, 1)]
    return pa.StructArray.from_arrays(cols, names=["hi", "lo"], mask=pa.array(none))


def fingerprint(text):
    """Column of the SimHash of a text column; null where the text has no word."""
    return arrow(_fingerprint, "struct<hi:bigint,lo:bigint>")(F.lower(text))


def blocks_for(n: int, budget: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, bound) of the blocks, for ``n`` fingerprints: those with the least expected work.

    Counted are the pairs of nodes that a walk meets down to where subtrees are
    small, and the pairs of leaves below.
    """
    def ball(bits: int, bound: int) -> int:
        return sum(math.comb(bits, k) for k in range(bound + 1))

    def work(blocks) -> float:
        total = 0.0
        for _, w, t in blocks:
            stop = min(w, max(0, math.ceil(math.log2(max(1, n)))))
            total += n * n / 2 * ball(stop, t) / 2**stop + sum(2**d * ball(d, t) for d in range(stop))
        return total

    best = None
    for count in range(1, min(16, budget + 1) + 1):
        each, more = divmod(budget + 1, count)
        at = [BITS * k // count for k in range(count + 1)]
        made = [(x, y - x, each - (k >= more)) for k, (x, y) in enumerate(zip(at, at[1:]))]
        if best is None or work(made) < work(best):
            best = made
    return best


def _turn(hi: np.ndarray, lo: np.ndarray, r: int) -> np.ndarray:
    """uint64[n, 2] that begins with bit ``r``; the bits before it come last."""
    a, b = (hi, lo) if r < 64 else (lo, hi)
    r %= 64
    if r:
        s, t = np.uint64(r), np.uint64(64 - r)
        a, b = (a << s) | (b >> t), (b << s) | (a >> t)
    return np.stack([a, b], axis=1)


class _Forest:
    """Components of the pairs seen so far, as labels; a root is its own label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            on = a != b
            i, j, a, b = i[on], j[on], a[on], b[on]
            if not len(i):
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def trie_join(fp: np.ndarray, first: int, budget: int, bits: int, bound: int, emit, leaf: int = 16, most: int = 1 << 18) -> None:
    """Walk the trie of sorted ``fp`` (uint64[n, 2]) against itself; ``emit(i, j)`` gets pairs of rows within ``budget``.

    ``bound`` bounds the differing bits of the first ``bits`` levels. With
    ``first`` > 0, the rows before and from it are two tries, each sorted, and
    only pairs across them count.
    """
    n = len(fp)
    if n == 0:
        return
    tops = [(0, np.ascontiguousarray(fp[:first, 0])), (first, np.ascontiguousarray(fp[first:, 0]))]

    def leaves(a0, a1, b0, b1):
        na, nb = a1 - a0, b1 - b0
        size = na * nb
        for s, t in words.runs(np.r_[0, np.cumsum(size)], 1 << 17):
            z = size[s:t]
            which = np.repeat(np.arange(s, t), z)
            r = np.arange(len(which)) - np.repeat(np.cumsum(z) - z, z)
            down = r // nb[which]
            i, j = a0[which] + down, b0[which] + r - down * nb[which]
            if not first:
                on = i < j
                i, j = i[on], j[on]
            d = np.bitwise_count(fp[i, 0] ^ fp[j, 0]) + np.bitwise_count(fp[i, 1] ^ fp[j, 1])
            on = d <= budget
            if on.any():
                emit(i[on], j[on])

    def halves(lo, hi, depth, which):
        """Where the subtrees' ones begin."""
        if depth < 64:
            base, word = tops[which]
            bit = np.uint64(1 << (63 - depth))
            return base + np.searchsorted(word, (word[lo - base] & ~(bit | (bit - np.uint64(1)))) | bit)
        word, bit = fp[:, 1], np.uint64(127 - depth)
        x, y = lo.copy(), hi.copy()
        while True:
            on = np.flatnonzero(x < y)
            if not len(on):
                return x
            m = (x[on] + y[on]) // 2
            one = ((word[m] >> bit) & np.uint64(1)).astype(bool)
            y[on[one]] = m[one]
            x[on[~one]] = m[~one] + 1

    start = [np.array([v]) for v in ((0, first, first, n) if first else (0, n, 0, n))]
    stack = [(0, *start, np.zeros(1, np.int16))]
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        size = (a1 - a0) * (b1 - b0)
        small = (size <= leaf) | (depth == BITS)
        if depth >= bits:  # no bound prunes soon: compare what is left, if it isn't much
            small |= size <= 4096
        if small.any():
            leaves(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, diff = (v[~small] for v in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        am, bm = halves(a0, a1, depth, 0 if first else 1), halves(b0, b1, depth, 1)
        same = (a0 == b0) & (a1 == b1)
        limit = bound if depth < bits else budget
        parts = []
        for x0, x1, y0, y1, more, keep in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            on = (x1 > x0) & (y1 > y0) & (diff + more <= limit)
            if keep is not None:
                on &= keep
            parts.append((x0[on], x1[on], y0[on], y1[on], diff[on] + np.int16(more)))
        nxt = [np.concatenate(v) for v in zip(*parts)]
        for s in range(0, len(nxt[0]), most):
            stack.append((depth + 1, *[v[s : s + most] for v in nxt]))


def _prefix(r: int, p: int) -> str:
    """SQL of bits ``r`` to ``r + p`` of (hi, lo), as a number; ``p`` < 32."""
    end, mask = r + p, (1 << p) - 1
    if not p:
        return "0L"
    if end <= 64:
        return f"(shiftrightunsigned(hi, {64 - end}) & {mask}L)"
    if r >= 64:
        return f"(shiftrightunsigned(lo, {128 - end}) & {mask}L)"
    return f"((shiftleft(hi, {end - 64}) | shiftrightunsigned(lo, {128 - end})) & {mask}L)"


def _joined(blocks: list[tuple[int, int, int]], budget: int):
    def run(t: pa.Table) -> pa.Table:
        hi, lo, at = t["hi"].to_numpy().view(np.uint64), t["lo"].to_numpy().view(np.uint64), t["fid"].to_numpy()
        g = t["g"][0].as_py()
        r, bits, bound = blocks[g >> 48]
        p, x, y = (g >> 43) & 31, (g >> 24) & ((1 << 19) - 1), g & ((1 << 24) - 1)
        fp = _turn(hi, lo, r)
        side = (fp[:, 0] >> np.uint64(64 - p)) != np.uint64(x) if x != y else None
        order = np.lexsort((fp[:, 1], fp[:, 0])) if side is None else np.lexsort((fp[:, 1], fp[:, 0], side))
        at, fp = at[order], fp[order]
        first = 0 if side is None else int(len(fp) - side.sum())
        forest = _Forest(len(fp))
        if side is None or 0 < first < len(fp):
            trie_join(fp, first, budget, bits, bound, forest.add)
        child = np.flatnonzero(forest.label != np.arange(len(fp)))
        return pa.table({"a": at[child], "b": at[forest.label[child]]})

    return run


def _depths(fps: DataFrame, n: int, blocks: list[tuple[int, int, int]], trie_size: int) -> list[int]:
    """For each block, the level at which its trie is cut into nodes: enough tasks, and no node of more than ``trie_size``."""
    cores = fps.sparkSession.sparkContext.defaultParallelism
    pairs = lambda p: sum((1 << p) * (sum(math.comb(min(p, w), k) for k in range(t + 1)) + 1) // 2 for _, w, t in blocks)
    p = 0
    while pairs(p) < 3 * cores and (2 << p) * 1024 <= n and p < 12:
        p += 1
    p = max(p, math.ceil(math.log2(max(1, n) / trie_size)))
    most = min(18, min(w for _, w, _ in blocks))
    p = min(p, most)
    if n <= trie_size:
        return [p] * len(blocks)
    deep = min(12, most)
    nodes = F.explode(F.array(*[F.expr(f"{k * (1 << deep)}L + {_prefix(r, deep)}") for k, (r, _, _) in enumerate(blocks)]))
    largest = {r["k"]: r["n"] for r in fps.select(nodes.alias("v")).groupBy("v").count().groupBy(F.expr(f"cast(shiftright(v, {deep}) as int)").alias("k")).agg(F.max("count").alias("n")).collect()}
    # below the levels looked at, a node is taken to halve at each
    return [min(most, max(p, deep + math.ceil(math.log2(max(1, largest[k]) / trie_size)) if largest[k] > trie_size else p)) for k in range(len(blocks))]


def near_pairs(fps: DataFrame, budget: int = 18, trie_size: int = 1 << 19) -> DataFrame:
    """Edges (a, b) of ``fid`` that join all distinct fingerprints (fid, hi, lo) within ``budget`` bits of each other.

    Inside a task, pairs that a forest already connects add nothing and aren't
    returned; components stay exact, and a group of n copies gives n - 1 edges
    a block and not n * n.
    """
    if not 0 <= budget < 64:
        raise ValueError("budget must be from 0 to 63")
    n = fps.count()
    blocks = blocks_for(n, budget)
    parts = []
    for k, ((r, _, t), p) in enumerate(zip(blocks, _depths(fps, n, blocks, trie_size))):
        masks = [m for m in range(1 << p) if m.bit_count() <= t]
        q = _prefix(r, p)
        head = f"{(k << 48) | (p << 43)}L"
        parts.append(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> {head} | shiftleft(least({q}, {q} ^ m), 24) | greatest({q}, {q} ^ m))")
    v = fps.select("fid", "hi", "lo", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("g"))
    return v.groupBy("g").applyInArrow(_joined(blocks, budget), "a bigint, b bigint")


def _bit(hi: str = "hi", lo: str = "lo") -> str:
    """SQL of a fingerprint's place in the filter."""
    return f"(xxhash64({hi}, {lo}) & {(1 << FILTER_BITS) - 1}L)"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 18, trie_size: int = 1 << 19, out_simhash: str | None = "simhash", out_size: str | None = "group_size") -> DataFrame:
    """Documents left when one of each group of near copies stays: the one of least id (nulls last).

    Groups are the connected components of all pairs within ``budget`` bits.
    Texts without a word (null, empty, only signs) have no fingerprint and all
    stay, as groups of one. Rows that repeat both id and words are copies of
    each other; the one with the least text stays. An empty table gives an
    empty one. Adds the fingerprint in hex and the number of documents of the
    group (unless named None); input columns of those names give way, all
    others stay whatever they are called.

    Texts are fingerprinted once, into a staged table. A filter of bits tells
    which rows may be in a group of two or more; only those are shuffled, by
    id and fingerprint, so copies of one text go to different tasks.
    """
    spark = docs.sparkSession
    fr = Frame(docs)
    staged, _ = cut(fr.df.select("*", fingerprint(fr[text_col]).alias("f")).select(*fr.df.columns, "f.hi", "f.lo"))
    each = staged.where("hi is not null").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(fr[id_col]).alias("first"))
    fps, path = cut(each.select(F.monotonically_increasing_id().alias("fid"), "hi", "lo", "n", "first"))
    near, near_path = cut(components(near_pairs(fps.select("fid", "hi", "lo"), budget, trie_size)).groupBy("node").agg(F.min("root").alias("root")))
    marked, marked_path = cut(fps.join(near, fps.fid == near.node, "left").select("hi", "lo", "n", "first", F.expr("coalesce(root, case when n > 1 then fid end)").alias("root")))
    for p in (path, near_path):
        drop(spark, p)
    group = marked.where("root is not null")
    bits, _ = cut(group.select(F.expr(f"shiftright({_bit()}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({_bit()} & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")))

    def maybe(d: DataFrame) -> DataFrame:
        """Adds ``maybe``: true for each fingerprint that is in a group, and for few others."""
        hit = d.join(F.broadcast(bits), F.expr(f"shiftright({_bit()}, 6)") == F.col("word"), "left")  # 2**19 rows at most
        return hit.withColumn("maybe", F.expr(f"hi is not null and coalesce(shiftright(bits, cast({_bit()} & 63 as int)) & 1, 0) = 1")).drop("word", "bits")

    best = group.groupBy("root").agg(F.sum("n").alias("size"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "hi", "lo")).alias("s")).select("s.first", "s.hi", "s.lo", "size")
    lone = maybe(marked.where("root is null")).where("maybe").select("first", "hi", "lo", F.lit(1).cast("bigint").alias("size"))
    key = lambda i: (F.xxhash64(i, "hi", "lo").alias("k1"), F.xxhash64(F.lit(1), "lo", i.isNull(), i, "hi").alias("k2"))
    keep, _ = cut(best.unionByName(lone).select(*key(F.col("first")), "size"))
    drop(spark, marked_path)
    d = maybe(staged)
    again = W.partitionBy("k1", "k2").orderBy(fr[text_col])
    member = d.where("maybe").select("*", *key(fr[id_col])).withColumn("rn", F.row_number().over(again)).where("rn = 1").join(keep, ["k1", "k2"])
    cols = [*fr.df.columns, "hi", "lo"]
    kept = d.where("not maybe").select(*cols, F.lit(1).cast("bigint").alias("size")).unionByName(member.select(*cols, "size"))
    new = {}
    if out_simhash:
        new[out_simhash] = F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))
    if out_size:
        new[out_size] = F.col("size")
    return fr.close(kept, **new)
