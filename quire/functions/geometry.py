"""Column expressions over boxes and transforms. Smaller y is higher on the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def f32(v: float) -> Column:
    """A constant in single precision, so that comparisons with float columns stay in it."""
    return F.lit(v).cast("float")


def center(a: Column, b: Column) -> Column:
    return (a + b) / 2


def is_full_width(x_min: Column, x_max: Column, page_w: Column) -> Column:
    """FLT-8"""
    return ((x_max - x_min) > page_w * F.lit(S.FULL_WIDTH)) & (x_min < page_w * F.lit(S.LEFT_EDGE))


def off_axis(ctm: Column) -> Column:
    """FLT-6: a transform turned by more than 12 degrees from the axes; malformed ones aren't."""
    r = F.pmod(F.degrees(F.atan2(F.try_element_at(ctm, F.lit(2)), F.try_element_at(ctm, F.lit(1)))), F.lit(90.0))
    return F.coalesce((F.size(ctm) == 6) & (F.least(r, 90.0 - r) > S.WATERMARK_DEGREES + 1e-9), F.lit(False))


def affine(bx: Column, by: Column, ctm: Column, lx: Column, ly: Column) -> tuple[Column, Column]:
    """MTH-2: object to page; the identity where the transform is missing or malformed."""
    e = lambda i: F.try_element_at(ctm, F.lit(i + 1))
    ok = F.coalesce(F.size(ctm) == 6, F.lit(False))
    x = F.when(ok, bx + e(0) * lx + e(2) * ly + e(4)).otherwise(bx + lx)
    y = F.when(ok, by + e(1) * lx + e(3) * ly + e(5)).otherwise(by + ly)
    return x, y


def downscaled(w: Column, h: Column, dpi: Column) -> tuple[Column, Column]:
    """SRC-18: size of a page image whose longer side is at most 12 inches at ``dpi``."""
    most = F.greatest(F.lit(1.0), F.round(dpi * S.DPI_SIDE))
    long = F.greatest(w, h)
    fit = lambda v: F.when(long <= most, v).otherwise(F.greatest(F.lit(1.0), F.round(v * most / long)))
    return fit(w).cast("int"), fit(h).cast("int")


def inside(cx: Column, cy: Column, scale: tuple[Column, Column, Column, Column], box: tuple[Column, Column, Column, Column]) -> Column:
    """ORD-10: a point of the text's coordinates in a box (x0, x1, y0, y1) of the layout's, each divided by its page maximum."""
    tw, th, lw, lh = scale
    x0, x1, y0, y1 = box
    ok = (tw > 0) & (th > 0) & (lw > 0) & (lh > 0)
    return ok & (cx / tw >= x0 / lw) & (cx / tw <= x1 / lw) & (cy / th >= y0 / lh) & (cy / th <= y1 / lh)
