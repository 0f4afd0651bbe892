"""Rectangles, grids and buffer sizes as Catalyst expressions over long columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967295


def ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b).cast("long")


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def within(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a rectangle lies in an image; a far edge beyond 32 bits doesn't."""
    return (x + w <= F.least(width, F.lit(U32))) & (y + h <= F.least(height, F.lit(U32)))


def scaled_covering(x: Column, y: Column, w: Column, h: Column, denom: Column) -> Column:
    """The reduced-grid rectangle that covers a source one: start down, end up."""
    x0, y0 = floor_div(x, denom), floor_div(y, denom)
    return F.struct(x0.alias("x"), y0.alias("y"), (ceil_div(x + w, denom) - x0).alias("w"), (ceil_div(y + h, denom) - y0).alias("h"))


def strided_output_len(w: Column, h: Column, stride: Column, bpp: Column) -> Column:
    """stride * (h - 1) + w * bpp; 0 if empty, null on overflow."""
    return F.when((w == 0) | (h == 0), F.lit(0).cast("long")).otherwise(F.try_add(F.try_multiply(stride, h - 1), F.try_multiply(w, bpp)))


def buffer_error(w: Column, h: Column, stride: Column, out_len: Column, bpp: Column) -> Column:
    """The first rule that an output buffer breaks, null if none."""
    need = strided_output_len(w, h, stride, bpp)
    return F.when(need.isNull(), "SizeOverflow").when(stride < w * bpp, "StrideTooSmall").when(out_len < need, "OutputTooSmall")


def unit_count(units_x: Column, units_y: Column) -> Column:
    return F.least(units_x * units_y, F.lit(U32))


def mcu_geometry(width: Column, height: Column, max_h: Column, max_v: Column) -> Column:
    mw, mh = 8 * max_h, 8 * max_v
    cols, rows = ceil_div(width, mw), ceil_div(height, mh)
    return F.struct(mw.alias("mcu_width"), mh.alias("mcu_height"), cols.alias("cols"), rows.alias("rows"), unit_count(cols, rows).alias("count"))


def intersects(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    return (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def expanded_within(x0, y0, x1, y1, margin, bx0, by0, bx1, by1) -> Column:
    return F.struct(F.greatest(x0 - margin, bx0).alias("x0"), F.greatest(y0 - margin, by0).alias("y0"), F.least(x1 + margin, bx1).alias("x1"), F.least(y1 + margin, by1).alias("y1"))
