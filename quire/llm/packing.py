"""Best-fit packing of documents into sequences by exact complements.

Only the histogram of lengths, at most ``capacity`` numbers, decides the plan,
so planning doesn't grow with the corpus. For each length from the
longest down, an index of the sums of single lengths, pairs and triples that
are still available tells whether the gap can be filled exactly; such a
combination is consumed as often as the availability counts allow. Lengths
without an exact complement are left for best-fit: each goes where least space
is left. The plan is a list of ranges (length, rank of the piece within its
length) to sequences, by which every piece finds its place.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .shared import Frame, arrow, cut

#: Ranks within a length are taken in parts of about so many pieces, so that a common length is no single task.
PART = 1 << 20


class SumIndex:
    """How many single lengths, ordered pairs and ordered triples of available lengths have each sum up to ``capacity``."""

    def __init__(self, have: np.ndarray):
        self.size = len(have)
        self.one = (have > 0).astype(np.int64)
        self.two = self._cut(np.convolve(self.one, self.one))
        self.three = self._cut(np.convolve(self.two, self.one))

    def _cut(self, v: np.ndarray) -> np.ndarray:
        return np.rint(v[: self.size]).astype(np.int64)

    def _shift(self, v: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        if by < self.size:
            out[by:] = v[: self.size - by]
        return out

    def remove(self, x: int) -> None:
        """Length ``x`` has run out: the sums that it took part in go."""
        self.one[x] = 0
        self.two -= 2 * self._shift(self.one, x)
        if 2 * x < self.size:
            self.two[2 * x] -= 1
        self.three -= 3 * self._shift(self.two, x) + 3 * self._shift(self.one, 2 * x)
        if 3 * x < self.size:
            self.three[3 * x] -= 1


def _times(have: np.ndarray, combo: tuple[int, ...]) -> int:
    """How often these lengths can be taken together."""
    return min(int(have[v]) // n for v, n in Counter(combo).items())


def _pair(have: np.ndarray, gap: int, rest: tuple[int, ...]) -> tuple[tuple[int, int], int] | None:
    a = np.arange(1, gap // 2 + 1)
    many = np.minimum(have[a], have[gap - a])
    for k in np.argsort(-many, kind="stable")[:8]:
        if many[k] <= 0:
            break
        combo = (gap - int(a[k]), int(a[k]))
        if n := _times(have, (*rest, *combo)):
            return combo, n
    for k in np.flatnonzero(many):
        combo = (gap - int(a[k]), int(a[k]))
        if n := _times(have, (*rest, *combo)):
            return combo, n
    return None


def exact(have: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of up to four lengths that fill a sequence, with how often; ``have`` is reduced by them."""
    cap = len(have) - 1
    index = SumIndex(have)
    out: list[tuple[tuple[int, ...], int]] = []
    rest = have.copy()

    def take(combo, n):
        out.append((combo, n))
        for v in combo:
            rest[v] -= n
        for v in set(combo):
            if rest[v] == 0:
                index.remove(v)

    left = np.zeros_like(have)
    for x in range(cap, 0, -1):
        while rest[x] > 0:
            gap = cap - x
            if gap == 0:
                take((x,), int(rest[x]))
                continue
            if index.one[gap] and (n := _times(rest, (x, gap))):
                take((x, gap), n)
                continue
            if index.two[gap] and (found := _pair(rest, gap, (x,))):
                take((x, *found[0]), found[1])
                continue
            if index.three[gap]:
                hit = None
                for c in range(min(x, gap - 2), 0, -1):
                    if rest[c] and index.two[gap - c] and (found := _pair(rest, gap - c, (x, c))):
                        hit = ((x, c, *found[0]), found[1])
                        break
                if hit:
                    take(*hit)
                    continue
            left[x] = rest[x]
            rest[x] = 0
            index.remove(x)
    have[:] = left
    return out


def best_fit(have: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit of the lengths in falling order, a whole class of equal sequences at a time.

    The same as placing one piece after the other where least space is left:
    the fullest sequence that has room takes pieces of this length as long as
    any fits, then the next.
    """
    cap = len(have) - 1
    bins: dict[int, list[list]] = {}
    for x in range(cap, 0, -1):
        n = int(have[x])
        while n:
            gap = min((g for g in bins if g >= x), default=None)
            if gap is None:
                each = cap // x
                full, more = divmod(n, each)
                if full:
                    bins.setdefault(cap - each * x, []).append([(x,) * each, full])
                if more:
                    bins.setdefault(cap - more * x, []).append([(x,) * more, 1])
                break
            group = bins[gap]
            combo, count = group.pop()
            if not group:
                del bins[gap]
            each = gap // x
            full = min(count, n // each)
            if full:
                bins.setdefault(gap - each * x, []).append([combo + (x,) * each, full])
                n -= full * each
            count -= full
            if count and n < each and n:
                bins.setdefault(gap - n * x, []).append([combo + (x,) * n, 1])
                n, count = 0, count - 1
            if count:
                bins.setdefault(gap, []).append([combo, count])
    return [(tuple(c), n) for g in sorted(bins) for c, n in bins[g]]


@dataclass
class Plan:
    """Ranges of pieces: ``key`` is length << 40 | first rank; sorted."""

    key: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 40) | rank, side="right") - 1
        return self.first_bin[at] + rank - (self.key[at] & ((1 << 40) - 1)), self.offset[at]


def plan(have: np.ndarray) -> Plan:
    """``have[x]`` pieces of length x, for x up to the capacity."""
    have = have.astype(np.int64).copy()
    have[0] = 0
    taken = np.zeros(len(have), np.int64)
    rows, n_bins = [], 0
    for combo, n in exact(have) + best_fit(have):
        offset = 0
        for x in combo:
            rows.append(((x << 40) | int(taken[x]), n_bins, offset))
            taken[x] += n
            offset += x
        n_bins += n
    rows.sort()
    key, b, o = (np.array(v, np.int64) for v in (zip(*rows) if rows else ((), (), ())))
    return Plan(key, b, o, n_bins)


def _spread(rows: DataFrame, times: str, most: int, block: int = 1 << 16) -> DataFrame:
    """Each row ``times`` times (``most`` at most), with ``copy`` from 0. A row of very many goes to several tasks, a block to each."""
    if most > block:
        rows = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {block})"))).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        last = f"least({times} - block * {block}, {block}) - 1"
        return rows.withColumn("copy", F.explode(F.expr(f"sequence(block * {block}, block * {block} + {last})"))).drop("block")
    return rows.withColumn("copy", F.explode(F.expr(f"sequence(0L, {times} - 1)")))


def _offsets(sums: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """For (length, part) the pieces of that length in the parts before."""
    out, last, total = {}, None, 0
    for (x, q), n in sorted(sums.items()):
        total = total if x == last else 0
        out[x, q] = total
        last, total = x, total + n
    return out


def pack_lengths(lengths: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place (doc_id, n) documents of n tokens: (doc_id, piece, start, length, sequence, position).

    A document longer than ``capacity`` is cut into full pieces and a rest. A
    full piece is a sequence of its own, so they need no rank: a document's
    full pieces take as many numbers in a row. Rows of equal id and n count as
    one with a number of times until they are placed. Within a length (or
    among the full pieces) ranks are running sums over parts, as many as make
    ``PART`` pieces each; the driver gets one number for each of those.
    """
    spark = lengths.sparkSession
    d, _ = cut(lengths.select("doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("times")))
    full, rest = F.expr(f"greatest(n, 0) div {capacity}"), F.expr(f"cast(greatest(n, 0) % {capacity} as int)")
    d = d.select("doc_id", "n", "times", full.alias("full"), rest.alias("rest"))
    seen = d.groupBy("rest").agg(F.sum("times").alias("m"), F.sum(F.col("times") * F.col("full")).alias("whole"), F.count_if(F.col("full") > 0).alias("long"), F.max("times").alias("most")).collect()
    most = max((r["most"] for r in seen), default=0)
    n_full, long = sum(r["whole"] for r in seen), sum(r["long"] for r in seen)
    have = np.zeros(capacity + 1, np.int64)
    for r in seen:
        have[r["rest"]] = r["m"] if r["rest"] else 0
    made = plan(have)
    parts = {x: -(-int(m) // PART) for x, m in enumerate(have) if m}
    parts[0] = max(1, -(-long // PART))

    def parted(rows: DataFrame, length: Column) -> DataFrame:
        """Adds the part: of as many as the length has."""
        of = F.get(F.array(*[F.lit(parts.get(x, 1)) for x in range(capacity + 1)]), length)
        return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "n"), of).cast("int"))

    def ranked(rows: DataFrame, amount: str) -> DataFrame:
        """Adds ``rn``, the sum of ``amount`` over the rows before in the same part."""
        upto = W.partitionBy("length", "part").orderBy("doc_id", "n").rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumn("rn", F.sum(amount).over(upto) - F.col(amount))

    def before(rows: DataFrame, amount: str) -> dict[tuple[int, int], int]:
        """Where the parts of the lengths that have several begin; the others begin at 0."""
        several = [x for x, k in parts.items() if k > 1]
        if not several:
            return {}
        return _offsets({(r["length"], r["part"]): r["m"] for r in rows.where(F.col("length").isin(several)).groupBy("length", "part").agg(F.sum(amount).alias("m")).collect()})

    out = ("doc_id", "piece", "start", "length", "sequence", "position")
    # full pieces: sequences from 0 on
    w = parted(d.where("full > 0").withColumn("length", F.lit(0)).withColumn("amount", F.col("times") * F.col("full")), F.lit(0))
    sums = before(w, "amount")
    base = F.get(F.array(*[F.lit(int(sums.get((0, q), 0))).cast("bigint") for q in range(parts[0])]), F.col("part"))
    w = _spread(ranked(w, "amount").withColumn("base", base), "times", most)
    w = w.withColumn("piece", F.explode(F.expr("sequence(0, cast(full - 1 as int))")))
    whole = w.select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.lit(capacity).alias("length"), (F.col("base") + F.col("rn") + F.col("copy") * F.col("full") + F.col("piece")).alias("sequence"), F.lit(0).alias("position"))
    # rests: sequences of the plan, after those
    first = int(n_full)
    v = parted(d.where("rest > 0").withColumn("length", F.col("rest")), F.col("length"))
    sent = spark.sparkContext.broadcast((made, before(v, "times")))

    def run(length: pa.Array, part: pa.Array, rank: pa.Array) -> pa.Array:
        made, sums = sent.value
        x, q, r = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, part, rank))
        key, inv = np.unique((x << 32) | q, return_inverse=True)
        off = np.array([sums.get((k >> 32, k & 0xFFFFFFFF), 0) for k in key.tolist()], np.int64)
        b, o = made.place(x, r + off[inv]) if len(x) else (x, x)
        return pa.StructArray.from_arrays([pa.array(b + first), pa.array(o.astype(np.int32))], names=["b", "o"])

    v = _spread(ranked(v, "times"), "times", most).withColumn("at", arrow(run, "struct<b:bigint,o:int>")(F.col("length"), F.col("part"), F.col("rn") + F.col("copy")))
    some = v.select("doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("start"), "length", F.col("at.b").alias("sequence"), F.col("at.o").alias("position"))
    none = _spread(d.where("n <= 0"), "times", most).select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("length"), F.lit(None).cast("bigint").alias("sequence"), F.lit(None).cast("int").alias("position"))
    return whole.unionByName(some).unionByName(none).select(*out)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, length: Column | None = None, path: str = tokens.RANKS) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, piece, start, length, sequence, position), in tokens.

    Lengths are token counts of whole texts, or the column ``length`` if given.
    Every token of every document has exactly one place, and no sequence holds
    more than ``capacity``. Null and empty texts have one row of length 0 and
    null place. Rows that repeat an id are placed one by one; ties within a
    length are broken by id and piece. An empty table gives an empty one. Other
    columns are left behind, whatever they are called.
    """
    if length is not None:
        return pack_lengths(docs.select(F.col(f"`{id_col}`").alias("doc_id"), length.cast("bigint").alias("n")), capacity)
    fr = Frame(docs)
    return pack_lengths(fr.df.select(fr[id_col].alias("doc_id"), arrow(lambda a: pa.array(tokens.counts(a, path)), "bigint")(fr[text_col]).alias("n")), capacity)
