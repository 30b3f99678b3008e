"""Page width, column detection and reading order of positioned regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geometry as G
from ..functions import text as X
from ..functions.arrays import anchored, let, runs
from ..staging import spread


def with_page_width(regions: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-2, FLT-8: adds page_w, cx and full (spans the page)."""
    (regions,) = spread(keys, regions)
    w = F.greatest(F.max("x_max").over(W.partitionBy(*keys)), F.lit(0))
    d = regions.withColumn("page_w", w).withColumn("cx", G.center(F.col("x_min"), F.col("x_max")))
    return d.withColumn("full", G.is_full_width(F.col("x_min"), F.col("x_max"), F.col("page_w")))


def with_column_split(regions: DataFrame, keys: list[str]) -> DataFrame:
    """ORD-1: adds ``split``, the x of the gap between two columns, or null.

    The widest gap between neighbouring centres (the first on a tie) counts if
    it is 3% of the page at least, has two regions on either side and no region
    across it. All windows share the partitioning by page, so the whole takes
    one exchange.
    """
    page = W.partitionBy(*keys)
    d = with_page_width(regions, keys)
    body = ~F.col("full")
    by_x = W.partitionBy(*keys, "full").orderBy("cx", "region_idx")
    d = d.withColumn("__rn", F.row_number().over(by_x)).withColumn("__before", F.lag("cx").over(by_x))
    d = d.withColumn("__n", F.count("*").over(page)).withColumn("__nb", F.count_if(body).over(page))
    cand = F.when(body & F.col("__before").isNotNull(), F.struct((F.col("cx") - F.col("__before")).alias("gap"), (-F.col("__rn")).alias("i"), ((F.col("cx") + F.col("__before")) / 2).alias("mid")))
    d = d.withColumn("__best", F.max(cand).over(page))
    i = -F.col("__best.i") - 1  # regions on the left
    ok = (F.col("__n") >= S.MIN_REGIONS) & (F.col("page_w") > 0) & (F.col("__nb") >= S.MIN_REGIONS) & (F.col("__best.gap") > 0) & (F.col("__best.gap") >= F.col("page_w") * S.COLUMN_GAP) & (i >= S.MIN_SIDE) & (F.col("__nb") - i >= S.MIN_SIDE)
    d = d.withColumn("split", F.when(ok, F.col("__best.mid")))
    across = body & (F.col("x_min") < F.col("split")) & (F.col("split") < F.col("x_max"))
    d = d.withColumn("split", F.when(~F.bool_or(F.coalesce(across, F.lit(False))).over(page), F.col("split")))
    return d.drop("__rn", "__before", "__n", "__nb", "__best")


def reading_order(regions: DataFrame, keys: list[str], in_block: bool = False) -> DataFrame:
    """ORD-2/3 (ORD-4 with ``in_block``): adds ``section`` and ``pos``, the place in reading order.

    In two columns: full-width heads, left, right, full-width between, feet;
    within a block: full-width, left, right. Otherwise from the top down. Ties
    keep the input order.
    """
    page = W.partitionBy(*keys)
    d = with_column_split(regions, keys)
    y = F.col("y_min")
    top, bottom = F.min(F.when(~F.col("full"), y)).over(page), F.max(F.when(~F.col("full"), y)).over(page)
    d = d.withColumn("__top", top).withColumn("__bottom", bottom)
    side = F.when(F.col("cx") < F.col("split"), 1).otherwise(2)
    if in_block:
        section = F.when(F.col("full"), 0).otherwise(side)
    else:
        section = F.when(~F.col("full"), side).when(y < F.col("__top"), 0).when(y > F.col("__bottom"), 4).otherwise(3)
    d = d.withColumn("section", F.when(F.col("split").isNull() | (F.col("page_w") <= 0), 0).otherwise(section).cast("int"))
    pos = F.row_number().over(page.orderBy("section", "y_min", "region_idx"))
    return d.withColumn("pos", pos).drop("__top", "__bottom")


def _split(d: Column, w: Column) -> Column:
    """ORD-1 of an array (r, cx, full)."""

    def best(body):
        n = F.size(body)
        before = lambda i: F.get(body, i - 1)["cx"]
        gaps = F.transform(body, lambda b, i: F.when(before(i).isNotNull(), F.struct((b["cx"] - before(i)).alias("gap"), (-i).alias("i"), ((b["cx"] + before(i)) / 2).alias("mid"))))
        ok = lambda g: (w > 0) & (n >= S.MIN_REGIONS) & (g["gap"] > 0) & (g["gap"] >= w * S.COLUMN_GAP) & (-g["i"] >= S.MIN_SIDE) & (n + g["i"] >= S.MIN_SIDE)
        across = lambda x: F.coalesce(F.exists(body, lambda b: (b["x_min"] < x) & (x < b["x_max"])), F.lit(False))
        return let(F.array_max(gaps), lambda g: F.when(ok(g) & ~across(g["mid"]), g["mid"]))

    body = F.sort_array(F.transform(F.filter(d, lambda x: ~x["full"]), lambda x: F.struct(x["cx"].alias("cx"), x["r"]["region_idx"].alias("i"), x["r"]["x_min"].alias("x_min"), x["r"]["x_max"].alias("x_max"))))
    return F.when(F.size(d) >= S.MIN_REGIONS, let(body, best))


def ordered(items: Column, in_block: bool = False) -> Column:
    """``reading_order`` of a page or block that is one array of regions, without shuffle or sort of the table: the array in that order."""

    def placed(g):
        d, w, split = g["d"], g["w"], g["split"]
        side = lambda x: F.when(x["cx"] < split, 1).otherwise(2)
        if in_block:
            section = lambda x: F.when(x["full"], 0).otherwise(side(x))
            rows = lambda at: F.transform(d, lambda x: F.struct(at(x).alias("s"), x["r"]["y_min"].alias("y"), x["r"]["region_idx"].alias("i"), x["r"].alias("r")))
            return rows(lambda x: F.when(split.isNull(), 0).otherwise(section(x)))
        tops = F.transform(F.filter(d, lambda x: ~x["full"]), lambda x: x["r"]["y_min"])
        section = lambda x, t: F.when(split.isNull(), 0).when(~x["full"], side(x)).when(x["r"]["y_min"] < t["top"], 0).when(x["r"]["y_min"] > t["bottom"], 4).otherwise(3)
        row = lambda x, t: F.struct(section(x, t).alias("s"), x["r"]["y_min"].alias("y"), x["r"]["region_idx"].alias("i"), x["r"].alias("r"))
        return let(F.struct(F.array_min(tops).alias("top"), F.array_max(tops).alias("bottom")), lambda t: F.transform(d, lambda x: row(x, t)))

    def wide(w):
        full = lambda r: G.is_full_width(r["x_min"], r["x_max"], w)
        return let(F.transform(items, lambda r: F.struct(r.alias("r"), G.center(r["x_min"], r["x_max"]).alias("cx"), full(r).alias("full"))), lambda d: F.struct(d.alias("d"), w.alias("w"), _split(d, w).alias("split")))

    width = F.greatest(F.array_max(F.transform(items, lambda r: r["x_max"])), F.lit(0))
    return F.transform(F.sort_array(let(let(width, wide), placed)), lambda x: x["r"])


def is_tall(r: Column, page_w: Column) -> Column:
    """FLT-9: written downwards: far higher than wide, and narrow for the page."""
    w = F.greatest(r["x_max"] - r["x_min"], F.lit(1.0))
    return ((r["y_max"] - r["y_min"]) > w * S.VERTICAL_RATIO) & (w < page_w * S.VERTICAL_WIDTH)


def tall_texts(tall: Column) -> Column:
    """``vertical_columns`` and ``column_texts`` of a page's tall regions as one array: the texts of its columns from the right."""
    item = lambda r: F.struct(G.center(r["x_min"], r["x_max"]).cast("double").alias("cx"), r["region_idx"].cast("int").alias("i"), (r["x_max"] - r["x_min"]).cast("double").alias("w"), r["y_min"].cast("double").alias("y"), r["text"].alias("text"))

    def columns(cs):
        text = lambda c: F.regexp_replace(F.array_join(F.transform(c, lambda x: X.strip(F.coalesce(x["text"], F.lit("")))), "\n"), "^\n+", "")
        rows = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(x["y"].alias("y"), x["cx"].alias("cx"), x["i"].alias("i"), x["text"].alias("text"))))
        made = F.transform(cs, lambda c, j: F.struct(F.get(c, F.lit(0))["cx"].alias("a"), (-j).alias("g"), text(rows(c)).alias("line")))
        return F.filter(F.transform(F.sort_array(made, False), lambda c: c["line"]), lambda t: t != "")

    same = lambda a, x: F.abs(a - x["cx"]) <= F.greatest(x["w"] * S.VERTICAL_TOLERANCE, F.lit(S.VERTICAL_FLOOR))
    return let(F.sort_array(F.transform(tall, item)), lambda v: let(let(anchored(v, lambda x: x["cx"], same), lambda at: runs(v, at)), columns))


def vertical_columns(regions: DataFrame, keys: list[str]) -> DataFrame:
    """ORD-5: (keys, col_no, region_idx, text) of vertical writing: columns from the right, top down within.

    A column is anchored at its first region, so the fold over the sorted page
    is an ``aggregate`` inside the JVM; pages are bounded.
    """
    page = W.partitionBy(*keys)
    (regions,) = spread(keys, regions)
    d = regions.withColumn("__pw", F.greatest(F.max("x_max").over(page), F.lit(0)))
    w = F.col("x_max") - F.col("x_min")
    w1 = F.greatest(w, F.lit(1.0))
    cand = ((F.col("y_max") - F.col("y_min")) > w1 * S.VERTICAL_RATIO) & (w1 < F.col("__pw") * S.VERTICAL_WIDTH)
    item = F.struct(G.center(F.col("x_min"), F.col("x_max")).cast("double").alias("cx"), F.col("region_idx").cast("int").alias("region_idx"), w.cast("double").alias("w"), F.col("y_min").cast("double").alias("y"), F.col("text"))
    g = d.where(cand).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = "struct<a:double,g:int,out:array<struct<g:int,cx:double,region_idx:int,y:double,text:string>>>"

    def step(s, x):
        tol = F.greatest(x["w"] * S.VERTICAL_TOLERANCE, F.lit(S.VERTICAL_FLOOR))
        same = F.coalesce(F.abs(s["a"] - x["cx"]) <= tol, F.lit(False))
        n = F.when(same, s["g"]).otherwise(s["g"] + 1)
        row = F.struct(n.alias("g"), x["cx"].alias("cx"), x["region_idx"].alias("region_idx"), x["y"].alias("y"), x["text"].alias("text"))
        return F.struct(F.when(same, s["a"]).otherwise(x["cx"]).alias("a"), n.alias("g"), F.concat(s["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(0).alias("g"), F.array().cast("array<struct<g:int,cx:double,region_idx:int,y:double,text:string>>").alias("out")).cast(kind)
    f = g.select(*keys, F.aggregate("items", start, step)["out"].alias("o"))
    rows = f.select(*keys, F.explode("o").alias("o")).select(*keys, "o.*")
    anchor = rows.withColumn("__a", F.min("cx").over(W.partitionBy(*keys, "g")))
    right = W.partitionBy(*keys).orderBy(F.col("__a").desc(), "g")
    return anchor.select(*keys, F.dense_rank().over(right).alias("col_no"), F.row_number().over(W.partitionBy(*keys, "g").orderBy("y", "cx", "region_idx")).alias("row_no"), "region_idx", "text")


def vertical_paragraphs(regions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col_no, text): a vertical column's lines, one under the other, from the first that isn't blank; blank columns are left out."""
    return column_texts(vertical_columns(regions, keys), keys)


def column_texts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The same from the regions already placed in columns."""
    c = placed.groupBy(*keys, "col_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("r"))
    t = F.array_join(F.transform("r", lambda x: X.strip(F.coalesce(x["text"], F.lit("")))), "\n")
    return c.select(*keys, "col_no", F.regexp_replace(t, "^\n+", "").alias("text")).where("text <> ''")


def gutter(items: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """ORD-11: (keys, gutter): where most lines have their widest gap; null if fewer than three agree.

    Midpoints are clustered from the left, each cluster anchored at its first;
    the largest wins, the last on a tie.
    """
    at = W.partitionBy(*keys, line).orderBy("x", "item_idx")
    (items,) = spread(keys, items)
    d = items.withColumn("__pw", F.max(F.col("x") + F.col("width")).over(W.partitionBy(*keys)))
    d = d.withColumn("__end", F.lag(F.col("x") + F.col("width")).over(at))
    cand = F.when((F.col("x") - F.col("__end")) > F.col("__pw") * S.GUTTER_GAP, F.struct((F.col("x") - F.col("__end")).alias("gap"), (-F.col("item_idx")).alias("i"), ((F.col("x") + F.col("__end")) / 2).alias("mid")))
    lines = d.groupBy(*keys, line).agg(F.max(cand).alias("b"), F.max("__pw").alias("pw")).where("b is not null")
    pages = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("b.mid").cast("double"))).alias("m"), F.max("pw").cast("double").alias("pw"))
    kind = "array<struct<a:double,n:int,s:double>>"

    def step(tol):
        def one(acc, x):
            last = F.try_element_at(acc, F.lit(-1))
            same = F.coalesce(F.abs(last["a"] - x) <= tol, F.lit(False))
            grown = F.struct(last["a"].alias("a"), (last["n"] + 1).alias("n"), (last["s"] + x).alias("s"))
            fresh = F.struct(x.alias("a"), F.lit(1).alias("n"), x.alias("s"))
            return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

        return one

    c = pages.select(*keys, F.size("m").alias("n"), F.aggregate("m", F.array().cast(kind), step(F.col("pw") * S.GUTTER_TOLERANCE)).alias("c"))
    best = F.array_max(F.transform("c", lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"), x["s"].alias("s"))))
    c = c.withColumn("b", best)
    return c.select(*keys, F.when((F.col("n") >= S.MIN_CLUSTER) & (F.col("b.n") >= S.MIN_CLUSTER), F.col("b.s") / F.col("b.n")).alias("gutter"))


def split_lines(items: DataFrame, gutters: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """ORD-12: adds ``part`` (0 or 1): lines cut at the gap above 1% of the page that is nearest to the gutter."""
    at = W.partitionBy(*keys, line).orderBy("x", "item_idx")
    whole = W.partitionBy(*keys, line)
    items, gutters = spread(keys, items, gutters)
    d = items.join(gutters, keys, "left").withColumn("__pw", F.max(F.col("x") + F.col("width")).over(W.partitionBy(*keys)))
    d = d.withColumn("__end", F.lag(F.col("x") + F.col("width")).over(at))
    mid = (F.col("x") + F.col("__end")) / 2
    cand = F.when((F.col("x") - F.col("__end")) > F.col("__pw") * S.LINE_GAP, F.struct(F.abs(mid - F.col("gutter")).alias("d"), F.col("x").alias("x"), F.col("item_idx").alias("i")))
    d = d.withColumn("__cut", F.when(F.col("gutter").isNotNull(), F.min(cand).over(whole)))
    later = (F.col("x") > F.col("__cut.x")) | ((F.col("x") == F.col("__cut.x")) & (F.col("item_idx") >= F.col("__cut.i")))
    return d.withColumn("part", F.when(F.coalesce(later, F.lit(False)), 1).otherwise(0)).drop("__pw", "__end", "__cut")


def tabular_pages(items: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """FLT-11: (keys, tabular): pages of three lines at least with three segments at least."""
    at = W.partitionBy(*keys, line).orderBy("x", "item_idx")
    (items,) = spread(keys, items)
    d = items.withColumn("__pw", F.max(F.col("x") + F.col("width")).over(W.partitionBy(*keys)))
    d = d.withColumn("__end", F.lag(F.col("x") + F.col("width")).over(at))
    segs = d.groupBy(*keys, line).agg((F.count_if(F.col("x") - F.col("__end") > F.col("__pw") * S.LINE_GAP) + 1).alias("s"))
    return segs.groupBy(*keys).agg((F.count_if(F.col("s") >= 3) >= 3).alias("tabular"))
