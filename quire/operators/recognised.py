"""What recognition found on a page, as the rows that are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..staging import cut
from . import blocks as B
from . import grid as D
from . import lines as L

_BOX = ("x_min", "x_max", "y_min", "y_max")


def parts(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regions, layout elements, tables and region blocks of recognition rows (see ``ocr.RESULT``). FLT-18: blank regions go."""
    box = [F.col(c).cast("double").alias(c) for c in _BOX]
    of = lambda w: rows.where(F.col("what") == w)
    regions = of("region").select(*keys, F.col("idx").alias("region_idx"), *box, X.strip(F.col("text")).alias("text")).where("text <> ''")
    elements = of("element").select(*keys, F.col("idx").alias("el_idx"), "element_type", "order_index", *box, "text")
    tables = of("table").select(*keys, "idx", *box, F.col("text").alias("html"))
    blocks = of("block").select(*keys, F.col("idx").alias("rb_idx"), "order_index", "element_indices")
    return regions, elements, tables, blocks


def page_lines(regions: DataFrame, elements: DataFrame, region_blocks: DataFrame, keys: list[str], scale: DataFrame | None = None) -> DataFrame:
    """RND-6: (keys, pos, line): reading order, hyphens and widths, headings by the layout's titles, without fragments, list markers paired."""
    ordered = B.order_structure(regions, elements, region_blocks, keys, scale)
    d = L.merge_hyphens(ordered, keys, "pos").withColumn("line", X.half_width(F.col("line")))
    title = X.strip(F.col("text"))
    hints = elements.where(F.col("element_type").isin(*S.TITLE_TYPES)).select(*keys, F.col("el_idx").alias("hint_ord"), title.alias("title"), X.hint_level(title).alias("level")).where("title <> '' and level is not null")
    d = L.with_hints(d, hints, keys, "pos").select(*keys, "pos", X.title_prefixed(F.col("line"), F.col("hint"), numbering=False).alias("line"))
    return L.pair_markers(d.where(~X.is_noise_fragment(F.col("line"))), keys, "pos")


def contents(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """RND-7: body and table rows (keys, source, kind, pos, text), and grids of tables that the layout took for images.

    Regions whose centre lies in a recognised table, in an image that became a
    grid, or in a header or footer (FLT-10) don't count for the body.
    """
    regions, elements, tables, region_blocks = (cut(d) for d in parts(rows, keys))
    scale = cut(B.page_scale(regions, elements, keys))
    grids = cut(D.image_tables(regions, elements, keys, scale))
    images = elements.where("element_type = 'image'").join(grids.select(*keys), keys, "left_semi")
    margins = elements.where(F.col("element_type").isin(*S.MARGIN_TYPES))
    boxes = images.unionByName(margins).select(*keys, *_BOX)
    # without layout there is no scale, and no box either but those of tables, which are the text's own measure
    bare = regions.groupBy(*keys).agg(F.max("x_max").alias("tw"), F.max("y_max").alias("th")).select(*keys, "tw", "th", F.col("tw").alias("lw"), F.col("th").alias("lh"))
    whole = scale.unionByName(bare.join(scale.select(*keys), keys, "left_anti"))
    kept = cut(B.outside(regions, boxes.unionByName(tables.select(*keys, *_BOX)), keys, whole))
    line = page_lines(kept, elements, region_blocks, keys, scale)
    body = line.select(*keys, F.lit("ocr").alias("source"), F.lit("body").alias("kind"), F.col("pos").cast("long").alias("pos"), F.col("line").alias("text"))
    html = tables.where("html is not null").select(*keys, F.lit("ocr").alias("source"), F.lit("table_html").alias("kind"), F.col("idx").cast("long").alias("pos"), X.table_html(F.col("html")).alias("text"))
    return body.unionByName(html), grids
