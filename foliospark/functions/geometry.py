"""Boxes, affine maps, image sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def affine(x: Column, y: Column, m: list[Column]) -> Column:
    """struct<x,y>: the point under the six-number matrix [a b c d e f]."""
    a, b, c, d, e, f = m
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def affine_product(m: list[Column], n: list[Column]) -> list[Column]:
    """The matrix that maps by m, then by n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def unit_square_box(m: list[Column]) -> Column:
    """struct<x0,y0,x1,y1>: the box around the unit square's image under m, where an image is drawn."""
    corners = [affine(F.lit(float(x)), F.lit(float(y)), m) for x in (0, 1) for y in (0, 1)]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def box_gap(a: Column, b: Column, axis: str) -> Column:
    """Distance of two boxes along an axis; 0 where they overlap."""
    lo, hi = f"{axis}0", f"{axis}1"
    return F.greatest(F.lit(0.0), F.greatest(a[lo], b[lo]) - F.least(a[hi], b[hi]))


def boxes_touch(a: Column, b: Column, tolerance: float = 0.5) -> Column:
    return (box_gap(a, b, "x") <= tolerance) & (box_gap(a, b, "y") <= tolerance)


def png_size(content: Column, check: bool = True) -> Column:
    """struct<width,height> of a PNG's header; 800 by 1000 if there is none."""
    word = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    good = F.length(content) >= 24
    if check:
        good = good & (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A")
    return F.when(F.coalesce(good, F.lit(False)), F.struct(word(17).alias("width"), word(21).alias("height"))).otherwise(F.struct(F.lit(800).alias("width"), F.lit(1000).alias("height")))


def fit_size(width: Column, height: Column, most: int = 1288) -> Column:
    """struct<width,height> with the longer edge at most `most`; fractions are cut off."""
    scale = F.lit(float(most)) / F.greatest(width, height)
    cut = lambda x: F.floor(x * scale).cast("int")
    return F.when(F.greatest(width, height) > most, F.struct(cut(width).alias("width"), cut(height).alias("height"))).otherwise(F.struct(width.cast("int").alias("width"), height.cast("int").alias("height")))


def raster_size(width: Column, height: Column, most: int = 2048) -> Column:
    """struct<width,height> of a page image: the width is capped first, then the longer edge."""
    w = F.least(width, F.lit(most)).cast("double")
    h = height * w / width
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(w, h))
    return F.struct(F.floor(w * scale).cast("int").alias("width"), F.floor(h * scale).cast("int").alias("height"))


def a4_height(width: Column) -> Column:
    """A4 height for a width, halves to even."""
    return F.bround(width * 1.414).cast("int")


def fixed(c: Column, digits: int) -> Column:
    """A number with fixed digits, rounded half to even."""
    return F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))
