"""Rasters as tables of cells (col, row, value): windows by the inverse of their affine map, and bilinear warps as joins."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (a, b, c, d, e, f): the corner of cell (col, row) lies at x = a col + b row + c, y = d col + e row + f.
Affine = tuple[float, float, float, float, float, float]
#: Weights up to this are noise of the coordinates' last digits.
LEAST_WEIGHT = 1e-9


def place(affine: Affine, col: Column, row: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = affine
    return a * col + b * row + c, d * col + e * row + f


def _inverse(affine: Affine) -> Affine:
    a, b, c, d, e, f = affine
    det = a * e - b * d
    if not det:
        raise ValueError("the affine map has no inverse")
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def window_of(affine: Affine, min_x: float, min_y: float, max_x: float, max_y: float, padding: int = 0) -> tuple[int, int, int, int]:
    """(first col, first row, last col, last row) of the cells that a box meets, widened by so many cells."""
    a, b, c, d, e, f = _inverse(affine)
    corners = [(a * x + b * y + c, d * x + e * y + f) for x in (min_x, max_x) for y in (min_y, max_y)]
    low = [math.floor(min(p[i] for p in corners)) - padding for i in (0, 1)]
    high = [max(math.ceil(max(p[i] for p in corners)) - 1, low[i] + padding) + padding for i in (0, 1)]
    return low[0], low[1], high[0], high[1]


def window(cells: DataFrame, affine: Affine, min_x: float, min_y: float, max_x: float, max_y: float, padding: int = 0) -> DataFrame:
    """The cells that a box meets: comparisons of col and row alone, which reach the scan."""
    c0, r0, c1, r1 = window_of(affine, min_x, min_y, max_x, max_y, padding)
    return cells.where(F.col("col").between(c0, c1) & F.col("row").between(r0, r1))


def warp(cells: DataFrame, affine: Affine, target: Affine, cols: int, rows: int, project: Callable[[Column, Column], tuple[Column, Column]] | None = None, nodata: float | None = None) -> DataFrame:
    """col, row, value of a target grid of cols x rows cells: each centre's bilinear mean of the four source cells around it.

    ``project`` takes target coordinates to the source's system. Source cells that are missing, null, NaN or ``nodata`` have
    no weight and the others' weights are raised to 1; a cell without any is null. A cell that the source holds twice
    counts as the mean of its values. Every target cell asks for four source cells, which meet by key; sums are partial first.
    """
    inverse = _inverse(affine)
    grid = cells.sparkSession.range(cols * rows).select((F.col("id") % cols).cast("int").alias("col"), F.floor(F.col("id") / cols).cast("int").alias("row"))
    x, y = place(target, F.col("col") + 0.5, F.col("row") + 0.5)
    x, y = project(x, y) if project else (x, y)
    at = grid.select("col", "row", x.alias("__x"), y.alias("__y"))
    u, v = place(inverse, F.col("__x"), F.col("__y"))
    at = at.select("col", "row", (u - 0.5).alias("__u"), (v - 0.5).alias("__v"))
    fu, fv = F.col("__u") - F.floor("__u"), F.col("__v") - F.floor("__v")
    four = [F.struct((F.floor("__u") + i).cast("int").alias("c"), (F.floor("__v") + j).cast("int").alias("r"), ((fu if i else 1 - fu) * (fv if j else 1 - fv)).alias("w")) for i in (0, 1) for j in (0, 1)]
    asked = at.select("col", "row", F.explode(F.array(*four)).alias("s")).select("col", "row", F.col("s.c").alias("__c"), F.col("s.r").alias("__r"), F.col("s.w").alias("__w")).where(F.col("__w") > LEAST_WEIGHT)
    value = F.col("value").cast("double")
    real = value.isNotNull() & ~F.isnan(value)
    real = real & (value != nodata) if nodata is not None else real
    source = cells.where(real).groupBy(F.col("col").cast("int").alias("__c"), F.col("row").cast("int").alias("__r")).agg(F.avg(value).alias("__value"))
    met = asked.join(source, ["__c", "__r"], "left")
    weight = F.when(F.col("__value").isNotNull(), F.col("__w"))
    return met.groupBy("col", "row").agg((F.sum(F.col("__w") * F.col("__value")) / F.sum(weight)).alias("value"))
