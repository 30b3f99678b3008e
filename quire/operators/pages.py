"""Across pages: continued tables, precedence of content, rendering to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def table_islands(pages: DataFrame, doc: str, pos: str, cols: str) -> DataFrame:
    """GRD-7: the pages with a grid and ``island``, the number of the table that each continues or begins.

    A page without grid, or one with another number of columns, ends a table.
    """
    w = W.partitionBy(doc).orderBy(pos)
    begins = F.col(cols).isNotNull() & ~F.coalesce(F.lag(cols).over(w) == F.col(cols), F.lit(False))
    d = pages.withColumn("island", F.sum(begins.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return d.where(F.col(cols).isNotNull())


def merge_tables(grids: DataFrame, pages: DataFrame, doc: str = "doc_id", pos: str = "page_pos") -> DataFrame:
    """GRD-6/7: one row for each table: (doc, first page, cols, has_header, header, rows).

    Of a continuation only the body counts; its first row goes if it repeats
    the header.
    """
    d = table_islands(pages.select(doc, pos).join(grids, [doc, pos], "left"), doc, pos, "cols")
    g = d.groupBy(doc, "island").agg(F.array_sort(F.collect_list(F.struct(pos, "cols", "has_header", "header", "rows"))).alias("p"))
    first = F.element_at("p", 1)
    texts = lambda r: F.transform(r, lambda c: c["text"])

    def body(p, i):
        again = first["has_header"] & (F.size(p["rows"]) > 0) & (texts(F.get(p["rows"], F.lit(0))) == texts(first["header"]))
        return F.when((i > 0) & F.coalesce(again, F.lit(False)), F.slice(p["rows"], 2, F.greatest(F.size(p["rows"]), F.lit(1)))).otherwise(p["rows"])

    return g.select(doc, first[pos].alias(pos), first["cols"].alias("cols"), first["has_header"].alias("has_header"), first["header"].alias("header"), F.flatten(F.transform("p", body)).alias("rows"))


def precedence(grid: Column, confirmed: Column, body: Column) -> Column:
    """RTE-16: what a page shows: its grid, else the table that recognition confirmed, else its lines."""
    return F.coalesce(grid, confirmed, body)


def page_content(keys: list[str], *levels: DataFrame) -> DataFrame:
    """RTE-16/17 for whole tables: of rows (keys, source, kind, pos, text) those of the first level that has the page."""
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more.join(out.select(*keys).distinct(), keys, "left_anti"))
    return out


def render_pages(regions: DataFrame, keys: list[str]) -> DataFrame:
    """RND-1..4: (keys, segment) from rows (keys, source, kind, pos, text); grids come as HTML text.

    The separators depend on neighbours only: a heading has an empty line
    before it, unless the page begins there or already ends in one, and one
    after it.
    """
    rank = F.when(F.col("kind") == "body", 0).when(F.col("kind") == "pre_rendered", 1).when(F.col("kind") == "table_html", 2).otherwise(3)
    d = regions.where((F.col("kind") != "table_html") | (F.col("source") == "ocr")).withColumn("__k", rank)
    w = W.partitionBy(*keys).orderBy("__k", "pos")
    plain = F.col("source") == "ofd"
    head = F.coalesce((F.col("__k") == 0) & F.col("text").startswith("#") & ~plain, F.lit(False))
    d = d.withColumn("__head", head).withColumn("__rn", F.row_number().over(w)).withColumn("__prev", F.lag(F.struct("__k", "__head", "text", (F.col("__rn") > 1).alias("more"))).over(w))
    t = F.col("text")
    # whether the segment so far ends in an empty line: a body line ends in one line end, so an empty line after another makes two
    p = F.col("__prev")
    body_open = ~(p["__head"] | p["text"].endswith("\n") | ((p["text"] == "") & p["more"]))
    ends = F.when(p.isNull(), F.lit(True)).when(p["__k"] == 0, F.when(plain, ~p["text"].endswith("\n\n")).otherwise(body_open)).otherwise(~p["text"].endswith("\n\n"))
    first = F.col("__rn") == 1
    body = F.when(plain, F.concat(F.when(first, F.lit("")).otherwise(F.lit("\n")), t)).otherwise(F.concat(F.when(F.col("__head") & ~first & ends, F.lit("\n")).otherwise(F.lit("")), t, F.when(F.col("__head"), F.lit("\n\n")).otherwise(F.lit("\n"))))
    html = F.concat(F.when(ends, F.lit("\n\n")).otherwise(F.lit("")), t)
    grid = F.when(F.col("source") == "ocr", F.concat(F.lit("\n\n"), t, F.lit("\n"))).otherwise(F.concat(t, F.lit("\n\n")))
    piece = F.when(F.col("__k") == 0, body).when(F.col("__k") == 1, t).when(F.col("__k") == 2, html).otherwise(grid)
    d = d.withColumn("__s", piece)
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", "pos", "__s"))).alias("p"))
    return g.select(*keys, F.array_join(F.transform("p", lambda x: x["__s"]), "").alias("segment"))


def render_documents(segments: DataFrame, doc: str, page: str, pos: str) -> DataFrame:
    """RND-5: (doc, markdown): pages by number, those of one number end to end, empty ones left out."""
    p = segments.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct(pos, "segment"))).alias("s"))
    p = p.select(doc, page, X.strip(F.array_join(F.transform("s", lambda x: x["segment"]), "")).alias("t"))
    g = p.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "t"))).alias("s"))
    return g.select(doc, F.array_join(F.transform(F.filter("s", lambda x: x["t"] != ""), lambda x: x["t"]), "\n\n").alias("markdown"))
