"""Tables rebuilt from positioned regions: rows, cells, columns, checks, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geometry as G
from ..functions import text as X
from ..functions.arrays import anchored, let, middle, runs, some
from ..staging import gathered


def upper_median(values: Column) -> Column:
    """AGG-5: element n/2 of the sorted array; null for an empty one."""
    v = F.array_sort(values)
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def row_groups(regions: DataFrame, keys: list[str], tolerance: Column) -> DataFrame:
    """GRD-1: (keys, region columns, row_no): rows from the top; a row holds what is within ``tolerance`` of its first region.

    The anchor makes this a fold and no window; it runs inside the JVM over the
    sorted page. ``tolerance`` is constant within a page.
    """
    rest = [c for c in regions.columns if c not in keys]
    item = F.struct(F.col("y_min").cast("double").alias("__y"), F.col("region_idx").cast("int").alias("__i"), F.struct(*rest).alias("r"))
    g = regions.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"), F.max(tolerance).cast("double").alias("__tol"))
    kind = "struct<a:double,g:int,out:array<int>>"

    def step(tol):
        def one(s, x):
            new = F.coalesce(F.abs(s["a"] - x["__y"]) > tol, F.lit(True))
            n = F.when(new, s["g"] + 1).otherwise(s["g"])
            return F.struct(F.when(new, x["__y"]).otherwise(s["a"]).alias("a"), n.alias("g"), F.concat(s["out"], F.array(n)).alias("out"))

        return one

    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out")).cast(kind)
    g = g.withColumn("__rows", F.aggregate("items", start, step(F.col("__tol")))["out"])
    z = g.select(*keys, F.explode_outer(F.arrays_zip("items", "__rows")).alias("z"))
    return z.select(*keys, "z.items.r.*", F.col("z.__rows").alias("row_no"))


def cells(rows: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """GRD-2/3: (keys, row_no, cell_no, x, y, h, text): a row's regions from the left, cut where more than ``gap`` lies between."""
    w = W.partitionBy(*keys, "row_no").orderBy("x_min", "region_idx")
    d = rows.withColumn("__cut", F.coalesce(F.col("x_min") - F.lag("x_max").over(w) > gap, F.lit(True)))
    d = d.withColumn("cell_no", F.sum(F.col("__cut").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    item = F.struct("x_min", "region_idx", "y_min", (F.col("y_max") - F.col("y_min")).alias("h"), "text")
    g = d.groupBy(*keys, "row_no", "cell_no").agg(F.array_sort(F.collect_list(item)).alias("i"))

    def join(s, t):
        blank = F.when(s.rlike("[A-Za-z0-9]$") & t.rlike("^[A-Za-z0-9]"), F.lit(" ")).otherwise(F.lit(""))
        return F.concat(s, blank, X.strip(t))

    text = F.aggregate(F.transform("i", lambda v: v["text"]), F.lit(""), join)
    first = F.element_at("i", 1)
    return g.select(*keys, "row_no", "cell_no", first["x_min"].alias("x"), first["y_min"].alias("y"), F.array_max(F.transform("i", lambda v: v["h"])).alias("h"), text.alias("text"))


def row_tolerance(regions: DataFrame, keys: list[str]) -> DataFrame:
    """GRD-4: (keys, page_w, row_tol): half the usual distance of rows, within 4 and 30% of the page."""
    p = regions.groupBy(*keys).agg(F.greatest(F.max("x_max"), F.lit(0)).alias("page_w"), F.coalesce(upper_median(F.collect_list(F.col("y_max") - F.col("y_min"))), F.lit(S.HEIGHT_DEFAULT)).alias("__rh"))
    coarse = row_groups(regions.join(p, keys), keys, F.greatest(F.col("__rh") * 0.8, F.lit(2.0)))
    c = cells(coarse, keys, F.col("page_w") * S.GRID_GAP).groupBy(*keys, "row_no").agg(F.avg("y").alias("__c"))
    d = c.withColumn("__d", F.abs(F.col("__c") - F.lag("__c").over(W.partitionBy(*keys).orderBy("row_no"))))
    pitch = d.groupBy(*keys).agg(F.coalesce(upper_median(F.collect_list("__d")), F.lit(S.PITCH_DEFAULT)).alias("__pitch"))
    upper = F.greatest(F.col("page_w") * S.ROW_CEILING, F.lit(S.ROW_FLOOR))
    tol = F.col("__pitch") * 0.5
    tol = F.when(F.isnan(tol), F.lit(S.ROW_FLOOR)).otherwise(F.least(F.greatest(tol, F.lit(S.ROW_FLOOR)), upper))
    return p.join(pitch, keys).select(*keys, "page_w", tol.alias("row_tol"))


def column_count(cell: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-6: (keys, cols): the largest number of cells, 2 at least, that two rows at least have."""
    n = cell.groupBy(*keys, "row_no").agg(F.count("*").alias("k")).where("k >= 2").groupBy(*keys, "k").agg(F.count("*").alias("m"))
    return n.where("m >= 2").groupBy(*keys).agg(F.max("k").cast("int").alias("cols"))


def column_centers(cell: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, center): upper median of x over the rows that have all columns."""
    n = F.count("*").over(W.partitionBy(*keys, "row_no"))
    full = cell.withColumn("__k", n).join(cols, keys).where("__k = cols")
    return full.groupBy(*keys, (F.col("cell_no") - 1).alias("col")).agg(upper_median(F.collect_list("x")).alias("center"))


def assign_cells(cell: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """JN-11: (keys, row_no, col, x, y, h, text): each cell at its nearest column, the first on a tie; of several in a place the leftmost.

    An empty place goes to whatever comes, so a cell without text gives way to a later one.
    """
    n = F.count("*").over(W.partitionBy(*keys, "row_no"))
    at = centers.groupBy(*keys).agg(F.collect_list(F.struct("col", "center")).alias("__c"))
    d = cell.withColumn("__k", n).where("__k >= 2").join(at, keys)
    nearest = F.array_min(F.transform("__c", lambda c: F.struct(F.abs(F.col("x") - c["center"]).alias("d"), c["col"].alias("col"))))
    near = d.withColumn("col", nearest["col"])
    pick = F.struct((F.col("text") == "").alias("e"), "x", "cell_no", "y", "h", "text")
    return near.groupBy(*keys, "row_no", "col").agg(F.min(pick).alias("__p")).select(*keys, "row_no", "col", "__p.x", "__p.y", "__p.h", "__p.text")


def alignment(placed: DataFrame, keys: list[str], page_w: Column, tolerant: bool = False) -> DataFrame:
    """AGG-7/8: (keys, aligned): whether the x of each column's filled cells, but for the first row, agree.

    Strict: the spread is within 2% of the page (10 at least). Tolerant: at most
    30% are farther than that from the upper median.
    """
    first = F.min("row_no").over(W.partitionBy(*keys))
    d = placed.withColumn("__first", first).withColumn("__tol", F.greatest(page_w * S.GRID_COLUMN, F.lit(S.GRID_COLUMN_FLOOR)))
    use = (F.col("row_no") > F.col("__first")) & (F.col("text") != "")
    c = d.groupBy(*keys, "col").agg(F.collect_list(F.when(use, F.col("x"))).alias("v"), F.max("__tol").alias("t"))
    if tolerant:
        c = c.withColumn("__m", upper_median(F.col("v")))
        ok = F.size(F.filter("v", lambda x: F.abs(x - F.col("__m")) > F.col("t"))) * 100 <= F.size("v") * S.GRID_OUTLIERS
    else:
        ok = F.array_max("v") - F.array_min("v") <= F.col("t")
    return c.groupBy(*keys).agg(F.bool_and((F.size("v") < 2) | ok).alias("aligned"))


def _page_rows(items: Column, tol: Column) -> Column:
    """``row_groups`` of a page's array of regions: an array for each row."""
    v = F.sort_array(F.transform(items, lambda r: F.struct(r["y_min"].cast("double").alias("y"), r["region_idx"].cast("int").alias("i"), r.alias("r"))))
    return let(v, lambda v: let(anchored(v, lambda x: x["y"], lambda a, x: F.abs(a - x["y"]) <= tol), lambda at: F.transform(runs(v, at), lambda row: F.transform(row, lambda x: x["r"]))))


def _row_cells(row: Column, gap: Column) -> Column:
    """GRD-2 of a row's array of regions: an array (x, i, y, h, text, end) for each cell."""
    v = F.transform(row, lambda r: F.struct(r["x_min"].alias("x"), r["region_idx"].alias("i"), r["y_min"].alias("y"), (r["y_max"] - r["y_min"]).alias("h"), r["text"].alias("text"), r["x_max"].alias("end")))
    apart = lambda v, c, i: F.coalesce(c["x"] - F.get(v, i - 1)["end"] > gap, F.lit(True))
    cut = lambda v: let(some(F.transform(v, lambda c, i: F.when(apart(v, c, i), i))), lambda at: runs(v, at))
    return F.when(F.size(row) == 1, F.array(v)).otherwise(let(F.sort_array(v), cut))


def _joined(text: Column, more: Column) -> Column:
    blank = F.when(text.rlike("[A-Za-z0-9]$") & more.rlike("^[A-Za-z0-9]"), F.lit(" ")).otherwise(F.lit(""))
    return F.concat(text, blank, X.strip(more))


def _made(cell: Column) -> Column:
    """GRD-3: (x, y, h, text) of a cell's regions."""
    first, texts = F.get(cell, F.lit(0)), F.transform(cell, lambda c: c["text"])
    text = F.when(F.size(cell) == 1, X.strip(first["text"])).otherwise(F.aggregate(texts, F.lit(""), _joined))
    return F.struct(first["x"].alias("x"), first["y"].alias("y"), F.array_max(F.transform(cell, lambda c: c["h"])).alias("h"), text.alias("text"))


def _page_cells(items: Column, tol: Column, gap: Column) -> Column:
    return let(_page_rows(items, tol), lambda rows: F.transform(rows, lambda row: F.transform(_row_cells(row, gap), _made)))


def _page_tolerance(items: Column, page_w: Column) -> Column:
    """``row_tolerance`` of a page's array of regions."""
    height = F.coalesce(middle(F.transform(items, lambda r: r["y_max"] - r["y_min"])), F.lit(S.HEIGHT_DEFAULT))
    tops = lambda row: some(F.transform(_row_cells(row, page_w * S.GRID_GAP), lambda c: F.get(c, F.lit(0))["y"].cast("double")))
    mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))
    means = let(let(F.greatest(height * 0.8, F.lit(2.0)), lambda tol: _page_rows(items, tol)), lambda rows: F.transform(rows, lambda row: let(tops(row), mean)))
    pitch = let(means, lambda m: middle(F.transform(m, lambda c, i: F.abs(c - F.get(m, i - 1)))))
    upper = F.greatest(page_w * S.ROW_CEILING, F.lit(S.ROW_FLOOR))
    return let(F.coalesce(pitch, F.lit(S.PITCH_DEFAULT)) * 0.5, lambda tol: F.when(F.isnan(tol), F.lit(S.ROW_FLOOR)).otherwise(F.least(F.greatest(tol, F.lit(S.ROW_FLOOR)), upper)))


def _page_placed(rows: Column) -> Column:
    """``column_count``, ``column_centers`` and ``assign_cells`` of a page's rows of cells: (cols, rows: array (row_no, row: array (e, x, cell_no, y, h, text) by column, null where none is)); null without columns."""
    count = lambda k: F.array_max(F.transform(k, lambda n, i: F.when((n >= 2) & (F.get(k, i - 1) == n), n)))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    centers = lambda full, n: F.transform(upto(n), lambda c: middle(F.transform(full, lambda r: F.get(r, c)["x"])))
    nearest = lambda x, cs: F.array_min(F.transform(cs, lambda c, i: F.struct(F.abs(x["x"] - c).alias("d"), i.alias("col"))))["col"]
    pick = lambda x, j: F.struct((x["text"] == "").alias("e"), x["x"].alias("x"), (j + 1).alias("cell_no"), x["y"].alias("y"), x["h"].alias("h"), x["text"].alias("text"))
    near = lambda r, cs: F.transform(r, lambda x, j: F.struct(nearest(x, cs).alias("col"), pick(x, j).alias("p")))
    row = lambda r, cs, n: let(near(r, cs), lambda m: F.transform(upto(n), lambda k: F.array_min(F.transform(F.filter(m, lambda x: x["col"] == k), lambda x: x["p"]))))
    wide = F.filter(F.transform(rows, lambda r, i: F.struct((i + 1).alias("row_no"), r.alias("r"))), lambda v: F.size(v["r"]) >= 2)
    placed = lambda cs, n: F.transform(wide, lambda v: F.struct(v["row_no"].alias("row_no"), row(v["r"], cs, n).alias("row")))
    all_ = lambda n: let(let(F.filter(rows, lambda r: F.size(r) == n), lambda full: centers(full, n)), lambda cs: placed(cs, n))
    return let(let(F.sort_array(F.transform(rows, lambda r: F.size(r))), count), lambda n: F.when(n.isNotNull(), F.struct(n.alias("cols"), all_(n).alias("rows"))))


def _page_aligned(placed: Column, page_w: Column, tolerant: bool) -> Column:
    """``alignment`` of a page's placed rows."""
    tol = F.greatest(page_w * S.GRID_COLUMN, F.lit(S.GRID_COLUMN_FLOOR))
    of = lambda k: some(F.transform(placed["rows"], lambda r, i: F.when((i > 0) & (F.get(r["row"], k)["text"] != ""), F.get(r["row"], k)["x"])))
    if tolerant:
        ok = lambda v: let(middle(v), lambda m: F.size(F.filter(v, lambda x: F.abs(x - m) > tol)) * 100 <= F.size(v) * S.GRID_OUTLIERS)
    else:
        ok = lambda v: F.array_max(v) - F.array_min(v) <= tol
    return F.forall(F.sequence(F.lit(0), placed["cols"] - 1), lambda k: let(of(k), lambda v: F.coalesce((F.size(v) < 2) | ok(v), F.lit(True))))


def _page_grid(placed: Column, page_w: Column, tolerant: bool) -> Column:
    """GRD-5 of a page's placed rows: (cols, all: its rows of (text, x, y, h)); null where it is no table."""
    single = lambda c: F.struct(c["text"].alias("text"), *[c[v].cast("float").alias(v) for v in ("x", "y", "h")])
    empty = F.struct(F.lit("").alias("text"), *[F.lit(0.0).cast("float").alias(v) for v in ("x", "y", "h")])
    filled = F.transform(placed["rows"], lambda r: F.transform(r["row"], lambda c: F.when(c.isNull(), empty).otherwise(single(c))))
    return F.when(placed.isNotNull(), F.when(_page_aligned(placed, page_w, tolerant), F.struct(placed["cols"].alias("cols"), filled.alias("all"))))


def _tables(pages: DataFrame, keys: list[str], tolerant: bool = False) -> DataFrame:
    """The pages (keys, items, page_w) that are tables.

    In steps, as Spark's analysis only takes so many functions within each
    other; what a step has from the one before it names once, so that nothing
    is worked out again where the plan puts steps together. The explode is
    outer, as the plan would else see in advance whether there is something.
    """
    c, many = F.col, F.size("items") >= 4
    d = pages.select(*keys, "items", "page_w", F.when(many, let(c("page_w"), lambda w: _page_tolerance(c("items"), w))).alias("tol"))
    d = d.select(*keys, "page_w", F.when(many, let(F.struct("page_w", "tol"), lambda v: _page_cells(c("items"), v["tol"], v["page_w"] * S.GRID_GAP))).alias("rows"))
    d = d.select(*keys, "page_w", F.when(c("rows").isNotNull(), let(c("rows"), _page_placed)).alias("placed"))
    d = d.select(*keys, let(F.struct("placed", "page_w"), lambda v: _page_grid(v["placed"], v["page_w"], tolerant)).alias("g"))
    g = d.select(*keys, F.explode_outer(some(F.array("g"))).alias("g")).where("g is not null")
    g = g.select(*keys, "g.cols", F.element_at("g.all", 1).alias("header"), F.slice("g.all", 2, F.size("g.all")).alias("rows"))
    return g.withColumn("has_header", is_header(F.transform("header", lambda v: v["text"]), F.transform(F.flatten("rows"), lambda v: v["text"]))).select(*keys, "cols", "has_header", "header", "rows")


_ITEM = ("region_idx", "x_min", "x_max", "y_min", "y_max", "text")


def _width(items: Column) -> Column:
    return F.greatest(F.array_max(F.transform(items, lambda r: r["x_max"])), F.lit(0))


def place(regions: DataFrame, keys: list[str], tolerance: Column, gap: Column) -> DataFrame:
    """GRD-1..3, AGG-5/6, JN-11 in one: (keys, row_no, col, x, y, h, text), what ``assign_cells`` gives from the regions' rows and cells."""
    pages = gathered(keys, r=regions.select(*keys, F.struct(*_ITEM).alias("r")))
    d = pages.select(*keys, _page_cells(F.col("r"), tolerance, gap).alias("rows"))
    d = d.select(*keys, F.explode_outer(let(F.col("rows"), _page_placed)["rows"]).alias("v"))
    return d.select(*keys, "v.row_no", F.posexplode_outer("v.row").alias("col", "c")).where("c is not null").select(*keys, "row_no", "col", "c.x", "c.y", "c.h", "c.text")


def reconstruct(regions: DataFrame, keys: list[str], tolerant: bool = False) -> DataFrame:
    """GRD-5: one row for each page that is a table: (keys, cols, has_header, header, rows) of text, x, y, h.

    A page's regions come together once; all steps work on that array.
    """
    pages = gathered(keys, r=regions.select(*keys, F.struct(*_ITEM).alias("r")))
    return _tables(pages.select(*keys, F.col("r").alias("items"), _width(F.col("r")).alias("page_w")), keys, tolerant)


def is_header(header: Column, body: Column) -> Column:
    """FLT-17: the first row names columns: a key word, or texts far shorter than the body's."""
    words = F.array_join(header, "").rlike("|".join(S.HEADER_WORDS))
    mean = lambda v: F.aggregate(v, F.lit(0), lambda s, t: s + F.length(t)) / F.greatest(F.size(v), F.lit(1))
    return words | ((F.size(body) > 0) & (mean(header) <= 5.0) & (mean(body) > mean(header) * 1.8))


def false_positive(tables: DataFrame, cell: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-12/13: (keys, false_positive) of recognised tables (keys, html_structure) and their cells (keys, row, col, text)."""
    t = X.strip(F.col("text"))
    some = F.coalesce(t != "", F.lit(False))
    a = cell.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(F.coalesce(F.col("row") + 1, F.lit(0))).alias("__r"), F.max(F.coalesce(F.col("col") + 1, F.lit(0))).alias("__c"), F.count_if(some).alias("__some"), F.count_if(some & X.is_prose(t)).alias("__long"))
    j = tables.join(a, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    prose = (zero("__c") == 2) & (zero("__some") > 0) & (zero("__long") * 10 > zero("__some") * S.PROSE_TENTHS)
    return j.select(*keys, ((zero("__r") < 2) | (zero("__c") < 2) | prose).alias("false_positive"))


def image_guard(elements: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-19, AGG-14: (keys, tried): pages with an image that may be a table: none whose figures have titles and tables none."""
    has = lambda t: F.bool_or(F.col("element_type") == t)
    return elements.groupBy(*keys).agg((has("image") & ~(has("figure_title") & ~has("table_title"))).alias("tried"))


def image_tables(regions: DataFrame, elements: DataFrame, keys: list[str], scale: DataFrame | None = None) -> DataFrame:
    """GRD-8: tables that the layout took for images: (keys, cols, has_header, header, rows)."""
    from . import blocks

    kinds = {"r": regions.select(*keys, F.struct(*_ITEM, (X.strip(F.col("text")) != "").alias("some")).alias("r")), "e": elements.select(*keys, F.struct("element_type", "x_min", "x_max", "y_min", "y_max").alias("e"))}
    if scale is not None:
        kinds["s"] = scale.select(*keys, F.struct("tw", "th", "lw", "lh").alias("s"))
    pages = gathered(keys, **kinds).where((F.size("r") > 0) & (F.size("e") > 0))
    pages = pages.withColumn("s", blocks.scale_of() if scale is None else F.get("s", F.lit(0)))
    has = lambda t: F.coalesce(F.exists("e", lambda e: e["element_type"] == t), F.lit(False))
    tried = has("image") & ~(has("figure_title") & ~has("table_title"))
    held = lambda r: F.exists("e", lambda e: (e["element_type"] == "image") & blocks.holds(r, e, F.col("s"), (r["y_min"] + r["y_max"]) / 2))
    grown = lambda r: F.struct(*[r[c].alias(c) for c in ("region_idx", "x_min", "y_min", "text")], F.greatest(r["x_max"], r["x_min"] + 1).alias("x_max"), F.greatest(r["y_max"], r["y_min"] + 1).alias("y_max"))
    inside = F.transform(F.filter("r", lambda r: r["some"] & held(r)), grown)
    pages = pages.select(*keys, "r", "e", "s", F.when(tried & F.col("s").isNotNull(), F.greatest(F.col("s.tw"), F.lit(0))).alias("page_w"))
    g = _tables(pages.select(*keys, F.when(F.col("page_w").isNotNull(), inside).alias("items"), "page_w"), keys, True)
    every = F.transform(F.flatten(F.concat(F.array("header"), F.col("rows"))), lambda v: v["text"])
    g = g.withColumn("__t", every).withColumn("__s", F.filter("__t", lambda t: t != ""))
    prose = (F.col("cols") == 2) & (F.size(F.filter("__s", X.is_prose)) * 10 > F.size("__s") * S.PROSE_TENTHS)
    return g.where((F.size("__s") * 100 >= F.size("__t") * S.IMAGE_FILL) & ~prose).drop("__t", "__s")


def from_structure(cell: DataFrame, keys: list[str], regions: DataFrame | None = None) -> DataFrame:
    """GRD-12: (keys, cols, has_header, header, rows): a grid by the row and column numbers of a structure model.

    ``cell`` has (keys, row, col, text) and, to be filled, a box. JN-12: a cell
    without text takes that of the first region (keys, region_idx, box, text)
    whose (centre x, top) lies about it.
    """
    box = {"x_min", "x_max", "y_min", "y_max"} <= set(cell.columns)
    n = lambda c: F.coalesce(F.col(c) if box else F.lit(0.0), F.lit(0.0))
    c = cell.where("row is not null and col is not null").select(*keys, "row", "col", F.coalesce("text", F.lit("")).alias("text"), G.center(n("x_min"), n("x_max")).alias("x"), n("y_min").alias("y"), F.greatest(n("y_max") - n("y_min"), F.lit(1.0)).alias("h"))
    size = c.groupBy(*keys).agg((F.max("col") + 1).cast("int").alias("cols"), (F.max("row") + 1).cast("int").alias("n_rows")).where("cols >= 2 and n_rows >= 2")
    if regions is not None:
        r = regions.where(F.col("text") != "").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("region_idx").alias("__i"), G.center(F.col("x_min"), F.col("x_max")).alias("__x"), F.col("y_min").alias("__y"), F.col("text").alias("__t"))
        on = (F.abs(F.col("__x") - F.col("x")) <= F.greatest(F.col("h") * 0.5, F.lit(1.0)) * 2) & (F.abs(F.col("__y") - F.col("y")) <= F.col("h") + 4.0)
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        fill = c.where("text = ''").join(r, on).groupBy(*keys, "row", "col").agg(F.min_by("__t", "__i").alias("__fill"))
        c = c.join(fill, [*keys, "row", "col"], "left").withColumn("text", F.when(F.col("text") == "", F.coalesce("__fill", F.lit(""))).otherwise(F.col("text"))).drop("__fill")
    g = c.join(size, keys).groupBy(*keys, "cols", "n_rows").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")), F.struct("text", *[F.col(v).cast("float").alias(v) for v in ("x", "y", "h")])))).alias("m"))
    empty = F.struct(F.lit("").alias("text"), *[F.lit(0.0).cast("float").alias(v) for v in ("x", "y", "h")])
    upto = lambda v: F.sequence(F.lit(0), F.col(v) - 1)
    g = g.select(*keys, "cols", F.transform(upto("n_rows"), lambda i: F.transform(upto("cols"), lambda j: F.coalesce(F.try_element_at(F.col("m"), F.struct(i.alias("row"), j.alias("col"))), empty))).alias("all"))
    g = g.select(*keys, "cols", F.element_at("all", 1).alias("header"), F.slice("all", 2, F.size("all")).alias("rows"))
    return g.withColumn("has_header", is_header(F.transform("header", lambda v: v["text"]), F.transform(F.flatten("rows"), lambda v: v["text"]))).select(*keys, "cols", "has_header", "header", "rows")


def _first(upto: Column, start: Column, stop) -> Column:
    """The least index from ``start`` to ``upto`` where ``stop`` holds; ``upto`` if it does nowhere before."""
    return F.array_min(F.filter(F.sequence(start, upto), lambda j: (j == upto) | stop(j)))


def _cell(text: Column, across: Column, down: Column) -> Column:
    return F.concat(F.lit("<td"), X.span_attributes(across, down), F.lit(">"), X.escape_html(text), F.lit("</td>"))


def row_pitch(rows: Column) -> Column:
    """The usual distance between neighbouring rows' tops: the upper median, 4 at least; 12 for fewer than two rows with text."""
    tops = F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: c["text"] != "")), lambda r: F.filter(r, lambda c: c["text"] != "")[0]["y"].cast("double"))
    n = F.size(tops)
    gaps = F.zip_with(F.slice(tops, 1, n - 1), F.slice(tops, 2, n - 1), lambda a, b: F.abs(a - b))
    return F.when(n > 1, F.greatest(upper_median(gaps), F.lit(S.PITCH_FLOOR))).otherwise(F.lit(S.PITCH_DEFAULT))


def to_html(grids: DataFrame) -> Column:
    """GRD-9: column of a grid's HTML; spans to the right over empty cells and down from tall ones.

    A cell goes down over as many rows as its height holds, and covers the
    empty cells there. One that isn't covered is written if it has text, is the
    row's first or follows a covered one; it goes right to the next that has
    text or is covered.
    """
    d = F.struct(F.col("header").alias("header"), F.col("rows").alias("rows"), F.col("cols").cast("int").alias("cols"), row_pitch(F.concat(F.array("header"), F.col("rows"))).alias("pitch"))
    zero, none = F.lit(0), F.lit("")

    def head(g):
        n = F.size(g["header"])
        text = lambda i: g["header"][i]["text"]
        starts = F.filter(F.sequence(zero, n - 1), lambda i: (i == 0) | (text(i) != ""))
        return F.array_join(F.transform(starts, lambda i: _cell(text(i), _first(n, i + 1, lambda j: text(j) != "") - i, F.lit(1))), "")

    def with_down(g):
        tall = lambda c: (c["text"] != "") & (c["h"].cast("double") > g["pitch"] * S.SPAN_FACTOR)
        down = lambda c, i: F.when(tall(c), F.greatest(F.lit(1), F.least(F.floor(c["h"].cast("double") / g["pitch"] + 0.5).cast("int"), F.size(g["rows"]) - i))).otherwise(F.lit(1))
        rows = F.transform(g["rows"], lambda r, i: F.transform(r, lambda c: F.struct(c["text"].alias("t"), down(c, i).alias("d"))))
        return F.struct(rows.alias("rows"), g["cols"].alias("cols"), head(g).alias("head"))

    def with_cover(g):
        most = F.array_max(F.transform(g["rows"], lambda r: F.array_max(F.transform(r, lambda c: c["d"]))))
        above = lambda i, k: F.exists(F.sequence(F.greatest(zero, i - most + 1), i - 1), lambda u: (g["rows"][u][k]["t"] != "") & (u + g["rows"][u][k]["d"] > i))
        hidden = lambda c, i, k: F.when((i > 0) & (most > 1) & (c["t"] == ""), above(i, k)).otherwise(F.lit(False))
        rows = F.transform(g["rows"], lambda r, i: F.transform(r, lambda c, k: F.struct(c["t"].alias("t"), c["d"].alias("d"), hidden(c, i, k).alias("v"))))
        return F.struct(rows.alias("rows"), g["cols"].alias("cols"), g["head"].alias("head"))

    def body(g):
        def row(r):
            starts = F.filter(F.sequence(zero, g["cols"] - 1), lambda k: ~r[k]["v"] & ((k == 0) | (r[k]["t"] != "") | r[F.greatest(zero, k - 1)]["v"]))
            stop = lambda j: (r[j]["t"] != "") | r[j]["v"]
            return F.concat(F.lit("<tr>"), F.array_join(F.transform(starts, lambda k: _cell(r[k]["t"], _first(g["cols"], k + 1, stop) - k, r[k]["d"])), ""), F.lit("</tr>"))

        return F.when(F.size(g["rows"]) > 0, F.array_join(F.transform(g["rows"], row), "")).otherwise(none)

    # one-element arrays name what each step made, so that nothing is worked out twice
    step = lambda made, then: F.transform(made, then)
    g = step(step(F.array(d), with_down), with_cover)
    return step(g, lambda v: F.concat(F.lit("<table><thead><tr>"), v["head"], F.lit("</tr></thead><tbody>"), body(v), F.lit("</tbody></table>")))[0]
