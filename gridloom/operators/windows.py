"""Windows of a raster, by pixels or by coordinates, and what they do to its georeferencing."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Affine:
    """x = ox + col * pw + row * skx; y = oy + col * sky + row * ph."""

    ox: float
    pw: float
    skx: float
    oy: float
    sky: float
    ph: float

    def to_map(self, col, row):
        """(x, y) of a pixel: of numbers, arrays or Columns."""
        return self.ox + col * self.pw + row * self.skx, self.oy + col * self.sky + row * self.ph

    def to_pixel(self, x: float, y: float) -> tuple[float, float]:
        det = self.pw * self.ph - self.skx * self.sky
        if not det:
            raise ValueError("the transform has no inverse")
        dx, dy = x - self.ox, y - self.oy
        return (self.ph * dx - self.skx * dy) / det, (self.pw * dy - self.sky * dx) / det

    def shift(self, col: float, row: float) -> Affine:
        x, y = self.to_map(col, row)
        return Affine(x, self.pw, self.skx, y, self.sky, self.ph)


@dataclass(frozen=True)
class Window:
    col_off: int
    row_off: int
    width: int
    height: int

    def scaled(self, level: int) -> Window:
        level = max(1, level)
        return Window(self.col_off // level, self.row_off // level, self.width // level, self.height // level)

    def fits(self, level: int) -> bool:
        """Whether the window has whole pixels at an overview level."""
        return all(v % level == 0 for v in (self.col_off, self.row_off)) and self.width >= level and self.height >= level


def by_pixels(width: int, height: int, col: int, row: int, w: int, h: int) -> Window:
    """A window that must lie inside the raster; nothing is clamped."""
    if not (0 <= col < width and 0 <= row < height):
        raise ValueError(f"the window's origin ({col}, {row}) is outside the raster")
    if w <= 0 or h <= 0:
        raise ValueError("the window's size must be positive")
    if col + w > width or row + h > height:
        raise ValueError("the window goes beyond the raster")
    return Window(col, row, w, h)


def by_map(affine: Affine, width: int, height: int, ulx: float, uly: float, lrx: float, lry: float) -> Window:
    """The pixels that a rectangle of map coordinates touches; corners in any order, clamped to the raster."""
    c0, r0 = affine.to_pixel(min(ulx, lrx), max(uly, lry))
    c1, r1 = affine.to_pixel(max(ulx, lrx), min(uly, lry))
    left, top = max(0, math.floor(c0)), max(0, math.floor(r0))
    right, bottom = min(width, math.ceil(c1)), min(height, math.ceil(r1))
    if right <= left or bottom <= top:
        raise ValueError("the rectangle misses the raster")
    return Window(left, top, right - left, bottom - top)


def crop(pixels: DataFrame, w: Window) -> DataFrame:
    """Pixels of the window, numbered from its corner. The filter goes down to the scan where row and col are stored."""
    inside = F.col("row").between(w.row_off, w.row_off + w.height - 1) & F.col("col").between(w.col_off, w.col_off + w.width - 1)
    return pixels.where(inside).withColumns({"row": F.col("row") - w.row_off, "col": F.col("col") - w.col_off})


def shift_georef(catalog: DataFrame, w: Window) -> DataFrame:
    """The window's affine, matrix and tie points for rows with those columns (``affine`` struct, ``matrix``, ``tiepoints``)."""
    a = F.col("affine")
    moved = F.struct(
        (a.ox + w.col_off * a.pw + w.row_off * a.skx).alias("ox"), a.pw.alias("pw"), a.skx.alias("skx"),
        (a.oy + w.col_off * a.sky + w.row_off * a.ph).alias("oy"), a.sky.alias("sky"), a.ph.alias("ph"),
    )
    m = lambda i: F.get("matrix", F.lit(i))
    matrix = F.transform(
        "matrix", lambda v, i: F.when(i == 3, m(3) + w.col_off * m(0) + w.row_off * m(1)).when(i == 7, m(7) + w.col_off * m(4) + w.row_off * m(5)).otherwise(v)
    )
    ties = F.transform("tiepoints", lambda t: t.withField("col", t.col - w.col_off).withField("row", t.row - w.row_off))
    return catalog.withColumns({"affine": F.when(a.isNotNull(), moved), "matrix": matrix, "tiepoints": ties, "width": F.lit(w.width), "height": F.lit(w.height)})


def whole_tiles(tiles: DataFrame, w: Window, tile: int, src_width: int, src_height: int) -> DataFrame:
    """Output tiles with ``copy``: whether the compressed source tile can be taken as it is (aligned, whole, inside)."""
    aligned = F.lit(w.col_off % tile == 0 and w.row_off % tile == 0)
    whole = (F.col("cols") == tile) & (F.col("rows") == tile)
    inside = (F.col("col_off") + w.col_off + tile <= src_width) & (F.col("row_off") + w.row_off + tile <= src_height)
    return tiles.withColumn("copy", aligned & whole & inside)
