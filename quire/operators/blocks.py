"""Regions against layout boxes: membership, claiming, leftovers. All joins carry the page key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geometry as G
from ..functions.arrays import let, some
from ..staging import gathered, spread
from . import columns, lines

_SIDES = ("x_min", "x_max", "y_min", "y_max")


def page_scale(regions: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-3: (keys, tw, th, lw, lh): the largest coordinates of a page's text and layout."""
    regions, boxes = spread(keys, regions.select(*keys, "x_max", "y_max"), boxes.select(*keys, "x_max", "y_max"))
    t = regions.groupBy(*keys).agg(F.max("x_max").alias("tw"), F.max("y_max").alias("th"))
    b = boxes.groupBy(*keys).agg(F.max("x_max").alias("lw"), F.max("y_max").alias("lh"))
    return t.join(b, keys)


def _prefixed(boxes: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return boxes.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in ("x_min", "x_max", "y_min", "y_max", *more)])


def _on(keys: list[str], cx: Column, cy: Column, scaled: bool) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    if scaled:
        return on & G.inside(cx, cy, tuple(F.col(c) for c in ("tw", "th", "lw", "lh")), tuple(F.col(f"__{c}") for c in ("x_min", "x_max", "y_min", "y_max")))
    return on & (cx >= F.col("__x_min")) & (cx <= F.col("__x_max")) & (cy >= F.col("__y_min")) & (cy <= F.col("__y_max"))


def claim(regions: DataFrame, boxes: DataFrame, keys: list[str], scale: DataFrame | None = None) -> DataFrame:
    """JN-2, JN-4: adds ``block_rank``, the first box (by rank) that holds the region's (centre x, top); null for none.

    With ``scale`` (see page_scale) text and layout are compared as shares of their page maxima.
    """
    regions, boxes = spread(keys, regions, boxes)
    at = boxes.groupBy(*keys).agg(F.collect_list(F.struct("block_rank", "x_min", "x_max", "y_min", "y_max")).alias("__boxes"))
    d = regions.join(at, keys, "left")
    cx, cy = G.center(F.col("x_min"), F.col("x_max")), F.col("y_min")
    sides = lambda b: (b["x_min"], b["x_max"], b["y_min"], b["y_max"])
    if scale is not None:
        d = d.join(scale.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("tw", "th", "lw", "lh")]), keys, "left")
        holds = lambda b: G.inside(cx, cy, tuple(F.col(f"__{c}") for c in ("tw", "th", "lw", "lh")), sides(b))
    else:
        holds = lambda b: (cx >= b["x_min"]) & (cx <= b["x_max"]) & (cy >= b["y_min"]) & (cy <= b["y_max"])
    rank = F.array_min(F.transform(F.filter("__boxes", holds), lambda b: b["block_rank"]))
    first = [*keys, "region_idx"]
    return d.select(*first, *[c for c in regions.columns if c not in first], rank.alias("block_rank"))


def outside(regions: DataFrame, boxes: DataFrame, keys: list[str], scale: DataFrame | None = None) -> DataFrame:
    """JN-3, FLT-10: the regions whose centre is in none of the boxes."""
    regions, boxes = spread(keys, regions, boxes)
    b = _prefixed(boxes, keys)
    d = regions
    if scale is not None:
        d = d.join(scale, keys, "left")
    cx, cy = G.center(F.col("x_min"), F.col("x_max")), G.center(F.col("y_min"), F.col("y_max"))
    return d.join(b, _on(keys, cx, cy, scale is not None), "left_anti").select(*regions.columns)


def block_order(elements: DataFrame, keys: list[str]) -> DataFrame:
    """ORD-7: non-noise layout elements with ``block_rank``: by order_index, those without one last, by their top."""
    w = W.partitionBy(*keys).orderBy(F.col("order_index").asc_nulls_last(), F.when(F.col("order_index").isNull(), F.col("y_min")), "el_idx")
    return elements.where(~F.col("element_type").isin(*S.NOISE_TYPES)).withColumn("block_rank", F.row_number().over(w))


def scale_of() -> Column:
    """AGG-3 of a page's arrays r and e; null without elements."""
    top = lambda a, c: F.array_max(F.transform(a, lambda v: v[c]))
    return F.when(F.size("e") > 0, F.struct(top("r", "x_max").alias("tw"), top("r", "y_max").alias("th"), top("e", "x_max").alias("lw"), top("e", "y_max").alias("lh")))


def _pages(keys: list[str], regions: DataFrame, elements: DataFrame, region_blocks: DataFrame | None = None, scale: DataFrame | None = None) -> DataFrame:
    """One row for each page that has regions: (keys, r, e, b, s), arrays of its regions, elements, region blocks that have an order, and the scale of its places."""
    pick = lambda *cols: F.struct(*cols)
    kinds = {"r": regions.select(*keys, pick("region_idx", "x_min", "x_max", "y_min", "y_max", "text", lines.is_head(F.col("text")).alias("head")).alias("r")), "e": elements.select(*keys, pick("el_idx", "order_index", *_SIDES, F.col("element_type").isin(*S.NOISE_TYPES).alias("noise")).alias("e"))}
    if region_blocks is not None:
        kinds["b"] = region_blocks.where("order_index is not null").select(*keys, pick("order_index", "rb_idx", "element_indices").alias("b"))
    if scale is not None:
        kinds["s"] = scale.select(*keys, pick("tw", "th", "lw", "lh").alias("s"))
    g = gathered(keys, **kinds).where(F.size("r") > 0)
    return g.withColumn("s", scale_of() if scale is None else F.get("s", F.lit(0)))


def holds(r: Column, b: Column, s: Column, y: Column | None = None) -> Column:
    """Whether the region's (centre x, top or ``y``) is in the box, as shares of the page."""
    return G.inside(G.center(r["x_min"], r["x_max"]), r["y_min"] if y is None else y, tuple(s[c] for c in ("tw", "th", "lw", "lh")), tuple(b[c] for c in _SIDES))


def _by_index(e: Column) -> Column:
    """ORD-7 of a page's elements: those that are no noise in order."""
    last = lambda x: x["order_index"].isNull()
    return F.sort_array(F.transform(F.filter(e, lambda x: ~x["noise"]), lambda x: F.struct(last(x).alias("last"), x["order_index"].alias("o"), F.when(last(x), x["y_min"]).alias("y"), x["el_idx"].alias("i"), *[x[c].alias(c) for c in _SIDES])))


def _by_blocks(e: Column, b: Column) -> Column:
    """JN-9 of a page's elements and region blocks: see fallback_elements."""
    at = lambda v, i, p, x: F.struct(v["order_index"].alias("b"), v["rb_idx"].alias("rb"), x["order_index"].isNull().alias("last"), x["order_index"].alias("o"), x["y_min"].alias("y"), p.alias("p"), *[x[c].alias(c) for c in _SIDES])
    refs = lambda v: F.transform(v["element_indices"], lambda i, p: F.transform(F.filter(e, lambda x: ~x["noise"] & (x["el_idx"] == i)), lambda x: at(v, i, p, x)))
    return F.sort_array(F.flatten(F.transform(b, lambda v: F.flatten(F.coalesce(refs(v), F.array())))))


def _claimed(r: Column, boxes: Column, s: Column) -> Column:
    """Array (k, r): each region and the place of the first box that holds it; null for none."""
    return F.transform(r, lambda x: F.struct(F.array_min(F.transform(boxes, lambda b, i: F.when(holds(x, b, s), i + 1))).alias("k"), x.alias("r")))


def _lines(rank: Column, items: Column) -> Column:
    return F.transform(lines.joined(items), lambda x: F.struct(rank.alias("block_rank"), x["pos"].alias("pos"), x["line"].alias("line")))


def _in_blocks(c: Column) -> Column:
    """Array (block_rank, pos, line) of the claimed regions: each block's in order, merged into paragraphs."""
    items = lambda k: F.transform(F.filter(c, lambda x: x["k"] == k), lambda x: x["r"])
    block = lambda k: let(let(items(k), lambda v: columns.ordered(v, in_block=True)), lambda v: _lines(k, v))
    return F.flatten(F.transform(F.sort_array(F.array_distinct(some(F.transform(c, lambda x: x["k"])))), block))


def _assembled(r: Column, e: Column, s: Column) -> Column:
    noise = lambda x: F.coalesce(F.exists(e, lambda b: b["noise"] & holds(x, b, s)), F.lit(False))
    left = lambda c: F.transform(F.sort_array(F.transform(F.filter(c, lambda x: x["k"].isNull() & ~noise(x["r"])), lambda x: F.struct(x["r"]["y_min"].alias("y"), x["r"]["region_idx"].alias("i"), x["r"].alias("r")))), lambda x: x["r"])
    return let(let(_by_index(e), lambda boxes: _claimed(r, boxes, s)), lambda c: F.concat(_in_blocks(c), let(left(c), lambda v: _lines(F.lit(2147483647), v))))


def _fallen_back(r: Column, e: Column, b: Column, s: Column) -> Column:
    rest = F.transform(columns.ordered(r), lambda x, i: F.struct(F.lit(0).alias("block_rank"), (i + 1).alias("pos"), x["text"].alias("line")))
    return let(let(let(_by_blocks(e, b), lambda boxes: _claimed(r, boxes, s)), _in_blocks), lambda own: F.when(F.size(own) > 0, own).otherwise(rest))


def assemble(regions: DataFrame, elements: DataFrame, keys: list[str], scale: DataFrame | None = None) -> DataFrame:
    """ORD-8: (keys, block_rank, pos, line): each block's regions in order and merged into paragraphs; leftovers whose (centre x, top) is outside noise boxes last, by their top.

    ``scale`` is that of the whole page, where ``regions`` are only a part of it.
    """
    d = _pages(keys, regions, elements, scale=scale)
    return _rows(d.select(*keys, _assembled(F.col("r"), F.col("e"), F.col("s")).alias("o")), keys)


def _rows(d: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each line of an array ``o``; outer, as the plan would else work the array out a second time to see whether it is empty."""
    return d.select(*keys, F.explode_outer("o").alias("o")).where("o is not null").select(*keys, "o.*")


def fallback_elements(region_blocks: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """JN-9: elements that are no noise with ``block_rank``: by their region block's order, then by their own, else by their top."""
    b = region_blocks.where("order_index is not null").select(*keys, F.col("order_index").alias("__block"), "rb_idx", F.posexplode("element_indices").alias("__p", "el_idx"))
    w = W.partitionBy(*keys).orderBy("__block", "rb_idx", F.col("order_index").asc_nulls_last(), "y_min", "__p")
    e = elements.where(~F.col("element_type").isin(*S.NOISE_TYPES)).join(b, [*keys, "el_idx"])
    return e.withColumn("block_rank", F.row_number().over(w)).drop("__p", "rb_idx", "__block")


def fallback_order(regions: DataFrame, elements: DataFrame, region_blocks: DataFrame, keys: list[str], scale: DataFrame | None = None) -> DataFrame:
    """ORD-9: (keys, block_rank, pos, line) for pages whose elements have no order: by region blocks, without leftovers; where that gives nothing, the regions in reading order."""
    d = _pages(keys, regions, elements, region_blocks, scale)
    return _rows(d.select(*keys, _fallen_back(F.col("r"), F.col("e"), F.col("b"), F.col("s")).alias("o")), keys)


def order_structure(regions: DataFrame, elements: DataFrame, region_blocks: DataFrame, keys: list[str], scale: DataFrame | None = None) -> DataFrame:
    """ORD-6: (keys, pos, line) of recognised pages: vertical writing first, then what its blocks hold.

    Pages of which a block that is no noise has an order go by it (ORD-7/8),
    the others by ORD-9. What vertical writing took counts there no more.
    """
    d = _pages(keys, regions, elements, region_blocks, scale)
    r, e, b, s = (F.col(c) for c in "rebs")
    width = F.greatest(F.array_max(F.transform(r, lambda x: x["x_max"])), F.lit(0))
    tall = let(width, lambda w: F.transform(r, lambda x: F.struct(F.coalesce(columns.is_tall(x, w), F.lit(False)).alias("t"), x.alias("r"))))
    part = lambda v, t: F.transform(F.filter(v, lambda x: x["t"] if t else ~x["t"]), lambda x: x["r"])
    has_order = F.coalesce(F.exists(e, lambda x: ~x["noise"] & x["order_index"].isNotNull()), F.lit(False))
    flat = lambda v: F.transform(F.when(has_order, _assembled(v, e, s)).otherwise(_fallen_back(v, e, b, s)), lambda x: x["line"])
    both = let(tall, lambda v: F.concat(let(part(v, True), columns.tall_texts), let(part(v, False), flat)))
    numbered = F.transform(both, lambda t, i: F.struct((i + 1).alias("pos"), t.alias("line")))
    return _rows(d.select(*keys, numbered.alias("o")), keys)
