"""Quality metrics of extractions, and timings."""

from __future__ import annotations

from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-9: (keys, n, p50, p95, max): element n/2 and element ceil(0.95 n) - 1 of the sorted values, 0 for none.

    Equal values are counted before the shuffle; the upper median is the
    discrete one of the values in falling order.
    """
    at = lambda p, order: F.coalesce(F.expr(f"percentile_disc({p}) within group (order by `{value}` {order})"), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), at(0.5, "desc").alias("p50"), at(0.95, "asc").alias("p95"), F.coalesce(F.max(value), F.lit(0.0)).alias("max"))


def page_timings(df: DataFrame, page: str, stage: str, ms: str, stages: list[str]) -> DataFrame:
    """AGG-10: (page, a column for each stage, total)."""
    sums = [F.coalesce(F.sum(F.when(F.col(stage) == s, F.col(ms))), F.lit(0.0)).alias(s) for s in stages]
    d = df.groupBy(page).agg(*sums)
    total = F.col(stages[0])
    for s in stages[1:]:
        total = total + F.col(s)
    return d.withColumn("total", total)


def timing_report(df: DataFrame, page: str, stage: str, ms: str, stages: list[str]) -> DataFrame:
    """SNK-4: (part, key, line) of a report: a line for each page with its stages and total, then each stage's percentiles."""
    shown = lambda c: F.format_string("%.1f", F.col(c).cast("double"))
    p = page_timings(df, page, stage, ms, stages)
    each = F.concat_ws(" ", F.concat(F.lit("page "), F.col(page).cast("string")), *[F.concat(F.lit(f"{s}="), shown(s)) for s in [*stages, "total"]])
    q = percentiles(df, [stage], ms)
    total = F.concat_ws(" ", F.col(stage), F.concat(F.lit("n="), F.col("n").cast("string")), *[F.concat(F.lit(f"{s}="), shown(s)) for s in ("p50", "p95", "max")])
    return p.select(F.lit(0).alias("part"), F.col(page).cast("string").alias("key"), each.alias("line")).unionByName(q.select(F.lit(1).alias("part"), F.col(stage).alias("key"), total.alias("line")))


def _recall(a: set, b: set) -> float:
    return len(a & b) / max(1, len(a))


def charset_recall(truth: Column, found: Column) -> Column:
    """MET-1"""
    chars = lambda c: F.array_distinct(F.filter(F.split(X.normalized(c), ""), lambda x: x != ""))
    return X.set_recall(chars(truth), chars(found))


def term_scores(truth: Column, found: Column, pattern: str = rf"[{X.CJK}]{{4,}}") -> tuple[Column, Column, Column]:
    """MET-2: recall, precision and F1 of the sets of terms that the pattern finds."""
    terms = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)))
    a, b = terms(truth), terms(found)
    r, p = X.set_recall(a, b), X.set_recall(b, a)
    return r, p, F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(F.lit(0.0))


def _grams(text: str, most: int) -> list[set]:
    """The sets of n-grams of ``text`` for n from 1 to ``most``."""
    now, sets = list(text), []
    for n in range(1, most + 1):
        if n > 1:
            now = list(map(add, now, text[n - 1 :]))  # each with the sign that follows it
        sets.append(set(now))
    return sets


def ngram_recalls(truth: Column, found: Column, most: int) -> Column:
    """MET-5: array of the recalls of n-grams for n from 1 to ``most``.

    A text that was the found one of the row before, as in rows of neighbouring
    lines, is cut once.
    """

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, made = [], None, []
        for x, y in zip(a, b):
            if x is None or y is None:
                out.append([None] * most)
                continue
            own = made if x == last else _grams(x, most)
            last, made = y, _grams(y, most)
            out.append(list(map(_recall, own, made)))
        return pd.Series(out, dtype="object")

    return run(truth, found)


def ngram_recall(truth: Column, found: Column, n: int) -> Column:
    """MET-5"""
    return F.element_at(ngram_recalls(truth, found, n), n)


def error_rate(truth: Column, found: Column) -> Column:
    """MET-4: edit distance over the truth's length; for an empty truth 0 or 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(found) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(truth, found) / F.length(truth))


def _opcodes(a: str, b: str) -> tuple[float, float, float, float, float]:
    import difflib

    m = difflib.SequenceMatcher(None, a, b)
    subs = dels = ins = 0
    for op, i, j, k, n in m.get_opcodes():
        if op == "replace":
            both = min(j - i, n - k)
            subs, dels, ins = subs + both, dels + j - i - both, ins + n - k - both
        elif op == "delete":
            dels += j - i
        elif op == "insert":
            ins += n - k
    size = max(1, len(a))  # an empty truth counts as found
    same = size - dels - subs
    r, p = same / size, same / max(1, len(b))
    return (subs + dels + ins) / size, r, p, (2 * r * p / (r + p) if r + p else 0.0), m.ratio()


def sequence_scores(truth: Column, found: Column) -> Column:
    """MET-3, MET-9: struct (cer, recall, precision, f1, ratio) from the matching blocks of two texts."""

    @F.pandas_udf("struct<cer:double,recall:double,precision:double,f1:double,ratio:double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_opcodes(x or "", y or "") for x, y in zip(a, b)], columns=["cer", "recall", "precision", "f1", "ratio"])

    return run(truth, found)


def heading_histogram(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """MET-6: (keys, level, n)."""
    return lines.select(*keys, X.heading_marks(F.col(line)).alias("level")).where("level > 0").groupBy(*keys, "level").agg(F.count("*").alias("n"))


def table_counts(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """MET-7: (keys, html_tables, pipe_tables)."""
    c = F.col(line)
    return lines.groupBy(*keys).agg(F.count_if(c.contains("<table")).alias("html_tables"), F.count_if(c.rlike(r"^\s*\|?[ :\-]*-{3,}[ :\-|]*\|[ :\-|]*$")).alias("pipe_tables"))
