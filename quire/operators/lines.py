"""Operators over the lines of a page or document: one row a line, ordered within its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..functions.arrays import let, middle, runs, some


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line), split at line ends."""
    return docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def line_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, a, b): each line but the last and the one after it, where they lie: without a shuffle."""
    lines = F.split(F.col(text), "\n")
    d = docs.select(F.col(key), lines.alias("__l")).select(key, "__l", F.posexplode(F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(0)))).alias("line_no", "b"))
    return d.select(key, "line_no", F.get("__l", F.col("line_no")).alias("a"), "b")


def _joined(df: DataFrame, keys: list[str], order: list[str], line: str, sep: str, names: tuple[str, str]) -> DataFrame:
    """One row for each run ``__run``: its first order value and its lines end to end."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line)))
    g = df.groupBy(*keys, "__run").agg(rows.alias("__rows"))
    return g.select(*keys, F.element_at("__rows", 1)[order[0]].alias(names[0]), F.array_join(F.transform("__rows", lambda r: r[line]), sep).alias(names[1]))


def merge_hyphens(df: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """PAR-2: (keys, order, line) with words divided at a line's end put together.

    A line that ends in a hyphen takes the next one if that begins with a lower-case
    ASCII letter, again and again. The condition needs neighbours only, so runs
    are islands of a lag window.
    """
    w = W.partitionBy(*keys).orderBy(order)
    last = X.rstrip(F.lag(line).over(w))
    taken = F.coalesce(last.endswith("-") & X.lstrip(F.col(line)).rlike("^[a-z]"), F.lit(False))
    d = df.select(*keys, order, line, taken.alias("__taken"))
    d = d.withColumn("__gives", F.coalesce(F.lead("__taken").over(w), F.lit(False))).withColumn("__run", F.sum(F.when(F.col("__taken"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    t = F.when(F.col("__taken"), X.lstrip(F.col(line))).otherwise(F.col(line))
    t = F.when(F.col("__gives"), F.regexp_replace(t, r"-[\p{IsWhite_Space}]*$", "")).otherwise(t)
    return _joined(d.withColumn(line, t), keys, [order], line, "", (order, line))


def paragraphs(df: DataFrame, keys: list[str], order: str, y: str, line: str = "line") -> DataFrame:
    """PAR-1: (keys, order, line): lines of one paragraph joined without separator.

    A paragraph ends where the gap exceeds 1.5 times the upper median gap (8 at
    least) and at headings.
    """
    w = W.partitionBy(*keys).orderBy(order)
    whole = W.partitionBy(*keys)
    d = df.select(*keys, order, line, F.abs(F.col(y) - F.lag(y).over(w)).alias("__gap"), is_head(F.col(line)).alias("__head"))
    # gaps by size, none last: the middle one is the median, and no row carries the others
    by_gap = W.partitionBy(*keys).orderBy(F.col("__gap").asc_nulls_last(), order)
    middle = F.row_number().over(by_gap) == F.floor(F.count("__gap").over(whole) / 2) + 1
    d = d.withColumn("__median", F.when(middle, F.col("__gap"))).withColumn("__median", F.max("__median").over(whole))
    limit = F.greatest(F.coalesce("__median", F.lit(S.PARAGRAPH_DEFAULT)), F.lit(S.PARAGRAPH_FLOOR)) * S.PARAGRAPH_FACTOR
    cut = F.col("__gap").isNull() | F.col("__head") | F.lag("__head").over(w) | (F.col("__gap") > limit)
    d = d.withColumn("__run", F.sum(F.when(cut, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return _joined(d, keys, [order], line, "", (order, line))


def is_head(line: Column) -> Column:
    return X.is_title(line) | X.is_marked(line)


def joined(items: Column) -> Column:
    """``paragraphs`` of a page or block that is one array (y_min, text, head: see is_head) in order: array of (pos, line)."""

    def starts(gaps):
        limit = F.greatest(F.coalesce(middle(gaps), F.lit(S.PARAGRAPH_DEFAULT)), F.lit(S.PARAGRAPH_FLOOR)) * S.PARAGRAPH_FACTOR
        cut = lambda r, i, most: F.get(gaps, i).isNull() | r["head"] | F.get(items, i - 1)["head"] | (F.get(gaps, i) > most)
        return let(limit, lambda most: some(F.transform(items, lambda r, i: F.when(cut(r, i, most), i))))

    def paragraphs(at):
        text = lambda rows: F.array_join(F.transform(rows, lambda r: r["text"]), "")
        return F.transform(runs(items, at), lambda rows, j: F.struct((F.get(at, j) + 1).alias("pos"), text(rows).alias("line")))

    return let(let(F.transform(items, lambda r, i: F.abs(r["y_min"] - F.get(items, i - 1)["y_min"])), starts), paragraphs)


def pair_markers(df: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """PAR-3: (keys, pos, line): lone list markers joined with the content that follows.

    A marker looks past page numbers to the next line; a heading or another
    marker ends the search. The page numbers it passed come before it.
    """
    c = F.col(line)
    ahead = W.partitionBy(*keys).orderBy(order)
    kind = F.when(X.is_marked(c), F.lit("h")).when(X.is_isolated_marker(c), F.lit("m")).when(X.is_page_number(c), F.lit("n")).otherwise(F.lit("t"))
    # a heading is no marker and a marker no page number, so one kind is enough
    d = df.select(*keys, order, line, kind.alias("__kind"))
    stop = F.struct(F.col(order).alias("at"), F.col("__kind").alias("kind"), c.alias("line"))
    # looked for from the end, as a running frame is linear and one that ends at the partition's end isn't
    back_to_front = W.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("__kind") != "n", stop), ignorenulls=True).over(back_to_front)
    back = F.last(F.when(F.col("__kind") != "n", stop), ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("__next", nxt).withColumn("__back", back)
    pairs = (F.col("__kind") == "m") & (F.col("__next.kind") == "t")
    taken = F.coalesce((F.col("__kind") == "t") & (F.col("__back.kind") == "m"), F.lit(False))
    out = F.when(F.coalesce(pairs, F.lit(False)), F.concat(c, F.lit(" "), X.lstrip(F.col("__next.line")))).otherwise(c)
    # page numbers behind a marker go before it; they share its place and come first
    moved = (F.col("__kind") == "n") & (F.col("__back.kind") == "m")
    place = F.when(F.coalesce(moved, F.lit(False)), F.col("__back.at")).otherwise(F.col(order))
    d = d.select(*keys, order, place.alias("__place"), F.when(F.col("__kind") == "m", 1).otherwise(0).alias("__late"), out.alias(line), taken.alias("__t")).where("not __t")
    pos = F.row_number().over(W.partitionBy(*keys).orderBy("__place", "__late", order))
    return d.select(*keys, pos.alias("pos"), line)


def with_hints(lines: DataFrame, hints: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """JN-10: each line's level by the first hint (keys, hint_ord, title, level) that equals, holds or is held by it; null without."""
    t = X.strip(F.col(line))
    h = hints.select(*[F.col(k).alias(f"__{k}") for k in keys], "hint_ord", "title", "level")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    on = on & (t.contains(F.col("title")) | F.col("title").contains(t))
    j = lines.join(h, on, "left").groupBy(*keys, order, line).agg(F.min_by("level", "hint_ord").alias("hint"))
    return j
