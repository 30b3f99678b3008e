"""Column expressions over a page that is one row: its regions as an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def some(values: Column) -> Column:
    """Those that aren't null."""
    return F.filter(values, lambda v: v.isNotNull())


def middle(values: Column) -> Column:
    """AGG-5: element n/2 of those that aren't null, sorted; null without any."""
    return let(F.sort_array(some(values)), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")))


def anchored(values: Column, at: Callable[[Column], Column], same: Callable[[Column, Column], Column]) -> Column:
    """Indexes where a run begins: at each that isn't ``same`` as the run's first, whose ``at`` (a double) is its anchor."""

    def step(s, x):
        new = ~F.coalesce(same(s["a"], x), F.lit(False))
        return F.struct(F.when(new, at(x)).otherwise(s["a"]).alias("a"), (s["i"] + 1).alias("i"), F.when(new, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"))

    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at")).cast("struct<a:double,i:int,at:array<int>>")
    return F.aggregate(values, start, step)["at"]


def runs(values: Column, starts: Column) -> Column:
    """The array cut before each of these indexes."""
    return F.transform(starts, lambda s, j: F.slice(values, s + 1, F.coalesce(F.get(starts, j + 1), F.size(values)) - s))
