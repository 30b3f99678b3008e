"""Repeated headers and footers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..functions.geometry import f32


def needed_pages(pages, ratio: float = S.FURNITURE_RATIO):
    """Pages that a text must stand on; the product is rounded up in single precision (16 of 25 pages at 60%, not 15)."""
    return F.greatest(F.lit(S.FURNITURE_MIN), F.ceil(pages.cast("float") * f32(ratio)))


def furniture_keys(items: DataFrame, doc: str, page: str, text: str, place: list[str] | None = None, ratio: float = S.FURNITURE_RATIO) -> DataFrame:
    """AGG-1: (doc, __text, place) that stand on most pages of a document.

    ``place`` are the binned coordinates (see ``binned``). Counting distinct
    pages combines before the shuffle; the number of pages is that of the
    highest page number, as pages without text count too.
    """
    place = place or []
    d = items.select(doc, page, X.strip(F.col(text)).alias("__text"), *place).where("__text <> ''")
    pages = items.groupBy(doc).agg(F.max(page).alias("__pages"))
    seen = d.groupBy(doc, "__text", *place).agg(F.count_distinct(page).alias("__n"))
    need = needed_pages(F.col("__pages"), ratio)
    return seen.join(pages, doc).where((F.col("__n") >= need) & (F.col("__pages") >= need)).select(doc, "__text", *place)


def binned(items: DataFrame, doc: str, page: str) -> DataFrame:
    """Adds x_bin and y_bin: hundredths of the page, truncated, in single precision.

    y counts from the page's foot here, as in a PDF: the page's height is taken
    from its topmost item.
    """
    x, y, w, h = (F.col(c).cast("float") for c in ("x", "y", "width", "height"))
    on = W.partitionBy(doc, page)
    d = items.withColumn("__mx", F.greatest(F.max(x + w).over(on), f32(1.0))).withColumn("__my", F.greatest(F.max(y + h).over(on), f32(1.0)))
    share = lambda a, size, of: (((a + size * f32(0.5)) / F.col(of)).cast("float") * f32(100.0)).cast("int")
    return d.withColumn("x_bin", share(x, w, "__mx")).withColumn("y_bin", share(y, h, "__my")).drop("__mx", "__my")


def strip_furniture(items: DataFrame, doc: str, page: str, text: str, place: list[str] | None = None, ratio: float = S.FURNITURE_RATIO) -> DataFrame:
    """FLT-7, JN-1: the items that are no furniture. The join's small side is broadcast by Spark when its size allows."""
    keys = furniture_keys(items, doc, page, text, place, ratio)
    d = items.withColumn("__text", X.strip(F.col(text)))
    return d.join(keys, [doc, "__text", *(place or [])], "left_anti").drop("__text")
