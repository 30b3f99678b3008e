"""Sharding along a Hilbert curve for file pruning in several dimensions.

Metadata columns are quantised to ``bits`` bits each and the coordinates turned
into a Hilbert index by the curve's automaton, a column expression that stays
inside the JVM. Rows are laid out by index and cut
into runs of about ``target`` weight: rows near in all dimensions share a file,
whose ranges then let a reader skip it.

The running weight that decides the cuts is three-level: sums by the leading 16
bits of the index (65,536 numbers at most, in one task), sums by whole index
within those, in parallel, and a window over the rows of one index. Whole rows
move once, hashed by their whole index, so a hot source is spread over as many
tasks as it has positions on the curve.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Frame, cut, drop

COARSE_BITS = 16


def log_bucket(v: str, bits: int) -> str:
    """SQL of the log-linear bucket of a number: its exponent, then the leading bits after it; null and negative give 0.

    The same in Spark and DuckDB.
    """
    m = bits - 5
    if m < 0:
        raise ValueError("a bucket takes 5 bits at least")
    n = f"(least(cast({v} as bigint), 2147483646) + 1)"
    e = f"cast(length(bin({n})) - 1 as bigint)"
    lead = f"substring(concat(bin({n}), '{'0' * m}'), 2, {m})"
    mant = " + ".join(f"(case when substring({lead}, {k + 1}, 1) = '1' then {1 << (m - 1 - k)} else 0 end)" for k in range(m)) or "0"
    return f"(case when {v} >= 0 then {e} * {1 << m} + {mant} else 0 end)"


@lru_cache(maxsize=8)
def tables(n: int) -> tuple[list[int], list[int]]:
    """Automaton of the curve in n dimensions: for state * 2**n + digit, the digit along the curve and the next state.

    A state is the corner where the curve enters a cell and its main direction
    (Hamilton and Rau-Chaplin, 2008).
    """
    size, full = 1 << n, (1 << n) - 1
    gray = lambda w: w ^ (w >> 1)
    inverse = {gray(w): w for w in range(size)}
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731 - trailing ones
    right = lambda v, k: ((v >> k % n) | (v << (n - k % n))) & full
    along, state = [], []
    for e in range(size):
        for d in range(n):
            for digit in range(size):
                w = inverse[right(digit ^ e, d + 1)]
                entry = gray(2 * ((w - 1) // 2)) if w else 0
                turn = 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
                along.append(w)
                state.append((e ^ right(entry, n - (d + 1) % n)) * n + (d + turn + 1) % n)
    return along, state


def hilbert_index(coords: list[str], bits: int) -> str:
    """SQL of the curve index of integer columns of ``bits`` bits: the automaton run over the bits from the top.

    One expression in which each coordinate occurs once a dimension, so the
    optimiser has nothing to multiply when it moves it.
    """
    n = len(coords)
    along, state = tables(n)
    digit = " + ".join(f"shiftleft(cast(shiftright(a.x{i}, b) & 1 as int), {i})" for i in range(n))
    at = f"a.s * {1 << n} + {digit} + 1"
    names = ", ".join(f"a.x{i} as x{i}" for i in range(n))
    start = ", ".join(f"cast({c} as bigint) as x{i}" for i, c in enumerate(coords))
    arr = lambda v: f"array({', '.join(map(str, v))})"
    step = f"struct(element_at({arr(state)}, {at}) as s, shiftleft(a.h, {n}) | cast(element_at({arr(along)}, {at}) as bigint) as h, {names})"
    return f"aggregate(sequence({bits - 1}, 0, -1), struct(0 as s, cast(0 as bigint) as h, {start}), (a, b) -> {step}, a -> a.h)"


def _coordinate_by_share(df: DataFrame, column: Column, bits: int) -> DataFrame:
    """(k, x): a value's share of the rows before it in order, nulls first. As many rows as values.

    Two-level: values are spread by ranges, their rows added up within each
    range, and only the ranges' sums meet in one task.
    """
    c, path = cut(df.groupBy(column.cast("string").alias("k")).agg(F.count("*").alias("n")))
    c, path2 = cut(c.repartitionByRange(F.col("k").asc_nulls_first()).select("k", "n", F.spark_partition_id().alias("p")))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = c.groupBy("p").agg(F.sum("n").alias("m"))
    parts = parts.select("p", (F.sum("m").over(upto(W.orderBy("p"))) - F.col("m")).alias("base"), F.sum("m").over(W.partitionBy()).alias("t"))
    before = F.sum("n").over(upto(W.partitionBy("p").orderBy(F.col("k").asc_nulls_first()))) - F.col("n")
    made, _ = cut(c.select("k", "n", "p", before.alias("b")).join(parts, "p").select("k", F.expr(f"(base + b) * {1 << bits} div t").alias("x")))
    drop(df.sparkSession, path)
    drop(df.sparkSession, path2)
    return made


def shard(df: DataFrame, logs: tuple[str, ...] = ("n_chars",), categories: tuple[str, ...] = ("source", "lang"), linear: tuple[str, ...] = ("doc_id",), weight: str = "n_chars", row_weight: int = 64, bits: int = 12, target: int = 32 << 20) -> DataFrame:
    """All rows and columns, with ``hilbert`` (curve index), ``curve_start`` (weight before the row) and ``shard``.

    ``logs`` are quantised on a logarithmic scale, ``categories`` by their
    values' cumulative share of rows, ``linear`` columns evenly between least
    and greatest. A row weighs ``row_weight`` and its ``weight`` column (null
    and negative count 0); a shard is a run of the curve of ``target``, the row
    that crosses the limit belonging to the former. Nulls have the least
    coordinate. Ties on the curve are broken by the columns named here, so only
    rows equal in all of them may change places. Input columns named as the new
    ones give way, all others stay whatever they are called. An empty table
    gives an empty one.
    """
    spark = df.sparkSession
    fr = Frame(df)
    n = len(logs) + len(categories) + len(linear)
    small = [(fr[c], _coordinate_by_share(fr.df, fr[c], bits)) for c in categories]
    ends, _ = cut(fr.df.agg(*[e for i, c in enumerate(linear) for e in (F.min(fr[c].cast("bigint")).alias(f"a{i}"), F.max(fr[c].cast("bigint")).alias(f"b{i}"))])) if linear else (None, "")

    def indexed(d: DataFrame, *keep: str) -> DataFrame:
        for i, (c, made) in enumerate(small):
            d = d.join(made.select(F.col("k").alias(f"k{i}"), F.col("x").alias(f"x{i}")), c.cast("string").eqNullSafe(F.col(f"k{i}")), "left")
        if linear:
            d = d.crossJoin(F.broadcast(ends))  # one row
        x = [log_bucket(fr.at(c), bits) for c in logs] + [f"x{i}" for i in range(len(small))]
        x += [f"coalesce(cast((cast({fr.at(c)} as decimal(38,0)) - a{i}) * {1 << bits} div (cast(b{i} as decimal(38,0)) - a{i} + 1) as bigint), 0)" for i, c in enumerate(linear)]
        w = F.greatest(F.coalesce(fr[weight].cast("bigint"), F.lit(0)), F.lit(0)) + row_weight
        return d.select(*keep, F.expr(hilbert_index(x, bits)).alias("h"), w.alias("w"))

    used = list(dict.fromkeys(fr.at(c) for c in (*logs, *categories, *linear, weight)))
    cells, path = cut(indexed(fr.df.select(*used)).groupBy("h").agg(F.sum("w").alias("w")).withColumn("top", F.shiftright("h", max(0, n * bits - COARSE_BITS))))
    coarse = cells.groupBy("top").agg(F.sum("w").alias("all"))
    coarse = coarse.select("top", (F.sum("all").over(W.orderBy("top").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("all")).alias("base"))
    within = W.partitionBy("top").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells, _ = cut(cells.join(coarse, "top").select("h", (F.col("base") + F.sum("w").over(within) - F.col("w")).alias("before")))
    drop(spark, path)
    d = indexed(fr.df, *fr.df.columns).join(cells, "h")
    run = W.partitionBy("h").orderBy(*[fr[c].asc_nulls_first() for c in (*linear, *logs, *categories)]).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("start", F.col("before") + F.sum("w").over(run) - F.col("w"))
    return fr.close(d, hilbert=F.col("h"), curve_start=F.col("start"), shard=F.expr(f"start div {target}"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in curve order within a file; one more exchange, by ranges of shards."""
    sharded.repartitionByRange("shard", "curve_start").sortWithinPartitions("shard", "curve_start").write.partitionBy("shard").parquet(path)


def sql(table: str = "documents", bits: int = 12, target: int = 32 << 20, row_weight: int = 64) -> str:
    """The same for DuckDB, for the dimensions n_chars, source, lang, doc_id."""
    def share(c):
        return f"select k, cast((sum(n) over (order by k nulls first rows unbounded preceding) - n) * {1 << bits} // sum(n) over () as bigint) as x from (select {c} as k, count(*) as n from {table} group by {c})"

    parts = [f"with s1 as ({share('source')}), s2 as ({share('lang')}), e as (select min(doc_id) as a, max(doc_id) as b from {table})"]
    dim = f"coalesce(cast((cast(doc_id as hugeint) - a) * {1 << bits} // (cast(b as hugeint) - a + 1) as bigint), 0)"
    cols = "doc_id, text, lang, source, n_chars"
    parts.append(f"p0 as (select {cols}, cast({log_bucket('n_chars', bits)} as bigint) as x0, s1.x as x1, s2.x as x2, {dim} as x3, cast(0 as bigint) as h, cast(0 as bigint) as s from {table} d join s1 on d.source is not distinct from s1.k join s2 on d.lang is not distinct from s2.k, e)")
    along, state = tables(4)
    last = "p0"
    for i, b in enumerate(range(bits - 1, -1, -1), 1):
        at = "s * 16 + " + " + ".join(f"(((x{k} >> {b}) & 1) << {k})" for k in range(4)) + " + 1"
        parts.append(f"p{i} as (select {cols}, x0, x1, x2, x3, cast((h << 4) + {along}[{at}] as bigint) as h, cast({state}[{at}] as bigint) as s from {last})")
        last = f"p{i}"
    w = f"greatest(coalesce(n_chars, 0), 0) + {row_weight}"
    parts.append(f"r as (select {cols}, h as hilbert, cast(sum({w}) over (order by h, doc_id nulls first, n_chars nulls first, source nulls first, lang nulls first rows unbounded preceding) - ({w}) as bigint) as curve_start from {last})")
    return ", ".join(parts) + f" select {cols}, hilbert, curve_start, curve_start // {target} as shard from r"
