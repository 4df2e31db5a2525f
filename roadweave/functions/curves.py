"""Damage curves as lists of (intensity, damage), on the driver: they have a few points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Curve = list[tuple[float, float]]


def scaled(curve: Curve, factor: float) -> Curve:
    """The curve over an axis that is ``factor`` times as long."""
    if factor <= 0:
        raise ValueError("the factor must be above 0")
    return sorted((x * factor, y) for x, y in curve)


def value_at(curve: Curve, x: float) -> float:
    points = sorted(curve)
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x0 <= x <= x1 and x1 > x0:
            return y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return points[0][1] if x <= points[0][0] else points[-1][1]


def grid(*curves: Curve) -> list[float]:
    """All curves' intensities, sorted, once each."""
    return sorted({x for c in curves for x, _ in c})


def mixed(a: Curve, b: Curve, share: float) -> Curve:
    """``share`` of one curve and the rest of the other, over both curves' intensities."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be within 0 and 1")
    return [(x, share * value_at(a, x) + (1 - share) * value_at(b, x)) for x in grid(a, b)]


def speed_left(depth: Column, free: float = 1.0, deepest: float = 1.0) -> Column:
    """Speed that falls in a line from ``free`` at depth 0 to 0 at ``deepest``."""
    if free < 0 or deepest <= 0:
        raise ValueError("the speed may not be below 0, nor the deepest 0 or below")
    return F.greatest(F.lit(0.0), F.least(F.lit(float(free)), free * (1 - depth / deepest)))
