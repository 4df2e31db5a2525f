"""Lines and grids, points and polygons, in planar coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def split_line(points: list[tuple[float, float]], x0: float, y0: float, dx: float, dy: float) -> list[tuple[int, int, float]]:
    """(column, row, length) of each piece of a line between the borders of grid cells, in the line's order."""
    out = []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        cuts = [0.0, 1.0]
        for a, b, o, d in ((ax, bx, x0, dx), (ay, by, y0, dy)):
            if a != b:
                lo, hi = sorted(((a - o) / d, (b - o) / d))
                cuts += [((o + k * d) - a) / (b - a) for k in range(int(np.ceil(lo)), int(np.floor(hi)) + 1)]
        t = np.unique(np.clip(cuts, 0, 1))
        mid = (t[1:] + t[:-1]) / 2
        length = np.hypot(bx - ax, by - ay) * np.diff(t)
        for m, n in zip(mid, length, strict=True):
            if n > 0:
                out.append((int(np.floor((ax + m * (bx - ax) - x0) / dx)), int(np.floor((ay + m * (by - ay) - y0) / dy)), float(n)))
    return out


def split_segments(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, x0: float, y0: float, dx: float, dy: float) -> tuple[np.ndarray, ...]:
    """(segment, column, row, length) of each piece of many segments, by ``split_line``'s sums, in the order of segments and along each."""
    seg, at = [np.arange(len(ax))] * 2, [np.zeros(len(ax)), np.ones(len(ax))]
    for a, b, o, d in ((ax, bx, x0, dx), (ay, by, y0, dy)):
        own = np.flatnonzero(a != b)
        ends = np.sort(np.stack([(a[own] - o) / d, (b[own] - o) / d]), axis=0)
        low = np.ceil(ends[0]).astype(np.int64)
        n = np.maximum(np.floor(ends[1]).astype(np.int64) + 1 - low, 0)
        s = np.repeat(own, n)
        k = np.repeat(low, n) + np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
        seg.append(s)
        at.append(((o + k * d) - a[s]) / (b[s] - a[s]))
    s, t = np.concatenate(seg), np.clip(np.concatenate(at), 0, 1)
    order = np.lexsort((t, s))
    s, t = s[order], t[order]
    own = np.flatnonzero((s[1:] == s[:-1]) & (t[1:] != t[:-1]))
    s, m, part = s[own], (t[own + 1] + t[own]) / 2, t[own + 1] - t[own]
    n = np.hypot(bx[s] - ax[s], by[s] - ay[s]) * part
    col, row = np.floor((ax[s] + m * (bx[s] - ax[s]) - x0) / dx), np.floor((ay[s] + m * (by[s] - ay[s]) - y0) / dy)
    kept = n > 0
    return s[kept], col[kept].astype(np.int64), row[kept].astype(np.int64), n[kept]


def intersect_grid(links: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """e_id, split_id, col, row, length, value: each link's pieces with their cells' values (null beyond the grid)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs, ys = ([np.asarray(v, float) for v in pdf[c]] for c in ("xs", "ys"))
            if not xs:
                continue
            line = np.repeat(np.arange(len(xs)), [max(len(v) - 1, 0) for v in xs])
            cut = lambda vs, part: np.concatenate([v[part] for v in vs])
            first, last = slice(None, -1), slice(1, None)
            s, col, row, n = split_segments(cut(xs, first), cut(ys, first), cut(xs, last), cut(ys, last), x0, y0, dx, dy)
            own = line[s]
            yield pd.DataFrame({"e_id": pdf["e_id"].to_numpy()[own], "split_id": np.arange(len(own)) - np.searchsorted(own, own), "col": col, "row": row, "length": n})

    of = lambda c: F.transform("vertices", lambda p: p[c].cast("double")).alias(c + "s")
    pieces = links.select("e_id", of("x"), of("y")).mapInPandas(run, "e_id string, split_id int, col int, row int, length double")
    return pieces.join(cells.select("col", "row", "value"), ["col", "row"], "left")


def in_box(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Links whose bounding box meets the box."""
    x = lambda f: f(F.transform("vertices", lambda p: p["x"]))
    y = lambda f: f(F.transform("vertices", lambda p: p["y"]))
    return df.where((x(F.array_max) >= min_x) & (x(F.array_min) <= max_x) & (y(F.array_max) >= min_y) & (y(F.array_min) <= max_y))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: whether an odd number of the ring's sides lies to the right of the point."""
    odd = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            odd = odd + crosses.cast("int")
    return odd % 2 == 1


def sides(polygons: DataFrame) -> DataFrame:
    """polygon, ax, ay, bx, by: the sides of each ring (polygon, ring array<struct<x, y>>), closed if it is not; null and empty rings have none."""
    polygons = polygons.where(F.size("ring") > 0)
    ring = F.concat("ring", F.slice("ring", 1, 1))
    pairs = F.explode(F.arrays_zip(F.slice(ring, 1, F.size("ring")).alias("a"), F.slice(ring, 2, F.size("ring")).alias("b")))
    return polygons.select("polygon", pairs.alias("s")).select("polygon", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _box(polygons: DataFrame) -> DataFrame:
    x, y = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    return polygons.where(F.size("ring") > 0).select("polygon", F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))


def _covered(low: str, high: str, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))


def within(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """id, polygon: each point (id, x, y) with every polygon (polygon, ring) that it lies in; points on a left or lower side count as inside.

    A point meets the polygons whose boxes cover its cell of a grid in both directions, and of these only the sides in its
    row of cells, so what is compared grows with what lies side by side.
    """
    boxes = _box(polygons).select("*", _covered("x0", "x1", cell).alias("column")).select("*", _covered("y0", "y1", cell).alias("row"))
    at = points.select("id", "x", "y", F.floor(F.col("x") / cell).alias("column"), F.floor(F.col("y") / cell).alias("row"))
    near = at.join(boxes, ["column", "row"]).where("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1").select("id", "x", "y", "row", "polygon")
    s = sides(polygons).where("ay <> by").withColumns({"low": F.least("ay", "by"), "high": F.greatest("ay", "by")})
    met = near.join(s.select("polygon", "ax", "ay", "bx", "by", _covered("low", "high", cell).alias("row")), ["polygon", "row"])
    crosses = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax"))
    return met.where(crosses).groupBy("id", "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", "polygon")


def to_side(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The distance from a point to a side."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def nearest_side(points: DataFrame, sides: DataFrame, names: list[str], cell: float = 1.0, digits: int = 9, reach: float | None = None) -> DataFrame:
    """id, the ``names`` of the nearest side (ax, ay, bx, by and the names) and the distance, ties (to ``digits`` places) to the first by name.

    Points meet the sides in their cell and the eight around it. One that found a side no farther than a cell's width is
    settled; the others go on with cells of twice the width, until a cell is wider than all that there is. Points with
    nothing within ``reach`` give no row.
    """
    s = checkpointed(sides.where("ax IS NOT NULL AND bx IS NOT NULL").withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")}))
    todo = checkpointed(points.select("id", "x", "y").where("x IS NOT NULL AND y IS NOT NULL"))
    extent = todo.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).union(s.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")))
    x0, x1, y0, y1 = extent.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    around = lambda c, width: F.explode(F.sequence(F.floor(F.col(c) / width) - 1, F.floor(F.col(c) / width) + 1))
    none = todo.where(F.lit(False)).join(s, F.col("x") == F.col("ax")).select("id", *names, F.lit(0.0).alias("distance"))
    found, width = none, cell
    last = x0 is None or s.isEmpty()
    while not last and not todo.isEmpty():
        last = width > max(x1 - x0, y1 - y0) or (reach is not None and width >= reach)
        probes = todo.select("*", around("x", width).alias("column")).select("*", around("y", width).alias("row"))
        in_cells = s.select("*", _covered("x0", "x1", width).alias("column")).select("*", _covered("y0", "y1", width).alias("row")).drop("x0", "x1", "y0", "y1")
        far = F.round(to_side(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")]), digits)
        best = probes.join(in_cells, ["column", "row"]).groupBy("id").agg(F.min(F.struct(far.alias("distance"), *names)).alias("m")).select("id", *[F.col("m")[c].alias(c) for c in names], "m.distance")
        best = checkpointed(best if last else best.where(F.col("distance") <= width))
        found = found.union(best)
        todo = checkpointed(todo.join(best, "id", "left_anti"))
        width *= 2
    return found if reach is None else found.where(F.col("distance") <= reach)


def nearest_polygon(points: DataFrame, polygons: DataFrame, cell: float = 1.0, digits: int = 9) -> DataFrame:
    """id, polygon, distance: the polygon with the nearest side, by ``nearest_side``."""
    return nearest_side(points, sides(polygons), ["polygon"], cell, digits)


def within_or_nearest(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """id, polygon: the first polygon by name that a point lies in, else the one with the nearest side (ties to nine places: the first by name)."""
    inside = checkpointed(within(points, polygons, cell).groupBy("id").agg(F.min("polygon").alias("polygon")))
    rest = points.join(inside, "id", "left_anti")
    return inside.union(nearest_polygon(rest, polygons, cell).select("id", "polygon"))


def segments_of(lines: DataFrame) -> DataFrame:
    """e_id, k, ax, ay, bx, by: the segments between the vertices of lines (e_id, vertices), in order from 0; shorter lines have none."""
    ends = F.posexplode(F.arrays_zip(F.slice("vertices", 1, F.size("vertices") - 1).alias("a"), F.slice("vertices", 2, F.size("vertices") - 1).alias("b"))).alias("k", "s")
    return lines.where(F.size("vertices") > 1).select("e_id", ends).select("e_id", "k", *[F.col(f"s.{v}.{c}").alias(f"{v}{c}") for v in "ab" for c in "xy"])


def snap(points: DataFrame, lines: DataFrame, reach: float | None = None, cell: float = 1.0) -> DataFrame:
    """id, e_id, place, x, y, distance: each point's nearest place on a line, if any within ``reach``; ties to the first line, then segment.

    ``place`` is the segment's number and how far along it the place is, from 0 to 1, added up.
    """
    parts = checkpointed(segments_of(lines))
    near = nearest_side(points, parts, ["e_id", "k"], cell, reach=reach)
    at = near.join(points.select("id", F.col("x").alias("px"), F.col("y").alias("py")), "id").join(parts, ["e_id", "k"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.coalesce(F.try_divide((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
    at = at.withColumn("t", F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))
    return at.select("id", "e_id", (F.col("k") + F.col("t")).alias("place"), (F.col("ax") + F.col("t") * dx).alias("x"), (F.col("ay") + F.col("t") * dy).alias("y"), "distance")


def split_lines(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """e_id, piece, vertices: each line (e_id, vertices) cut at its places of ``cuts`` (e_id, place), as ``snap`` gives them; pieces in order from 0.

    Cuts at a line's ends and repeated ones cut nothing; lines without cuts are one piece. Windows span one line.
    """
    corners = lines.select("e_id", F.size("vertices").alias("n"), F.posexplode("vertices").alias("k", "p")).select("e_id", "n", F.col("k").cast("double").alias("place"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    parts = segments_of(lines).select("e_id", "k", "ax", "ay", "bx", "by")
    at = cuts.select("e_id", "place", F.floor("place").cast("int").alias("k")).distinct().join(parts, ["e_id", "k"])
    t = F.col("place") - F.col("k")
    new = at.select("e_id", F.lit(None).cast("int").alias("n"), "place", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
    # A cut at a corner is that corner, marked.
    both = corners.withColumn("cut", F.lit(0)).union(new.withColumn("cut", F.lit(1))).groupBy("e_id", "place").agg(F.max("n").alias("n"), F.min_by(F.struct("x", "y"), "cut").alias("p"), F.max("cut").alias("cut"))
    whole = Window.partitionBy("e_id")
    both = both.withColumn("last", F.max("n").over(whole) - 1).withColumn("cut", F.when((F.col("place") > 0) & (F.col("place") < F.col("last")), F.col("cut")).otherwise(0))
    both = both.withColumn("piece", F.coalesce(F.sum("cut").over(whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    # A cut ends one piece and begins the next.
    ends = both.select("e_id", "place", "p", F.explode(F.when(F.col("cut") == 1, F.array("piece", F.col("piece") + 1)).otherwise(F.array("piece"))).alias("piece"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda v: v["p"])
    return ends.groupBy("e_id", "piece").agg(ordered.alias("vertices"))


def clip_lines(lines: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """e_id, polygon, length: how much of each line (e_id, vertices) lies in each polygon (polygon, ring).

    A segment of a line is cut where it crosses the sides of the polygons whose boxes its own box meets, cell by cell of a grid, and a
    piece is inside if its middle is. Only what crosses or lies in a polygon is compared with it.
    """
    parts = segments_of(lines).withColumnsRenamed({"ax": "px", "ay": "py", "bx": "qx", "by": "qy"})
    parts = checkpointed(parts.withColumns({"sx0": F.least("px", "qx"), "sx1": F.greatest("px", "qx"), "sy0": F.least("py", "qy"), "sy1": F.greatest("py", "qy")}))
    boxes = _box(polygons).select("*", _covered("x0", "x1", cell).alias("column")).select("*", _covered("y0", "y1", cell).alias("row"))
    at = parts.select("*", _covered("sx0", "sx1", cell).alias("column")).select("*", _covered("sy0", "sy1", cell).alias("row"))
    near = at.join(boxes, ["column", "row"]).where("sx1 >= x0 AND sx0 <= x1 AND sy1 >= y0 AND sy0 <= y1").select("e_id", "k", "px", "py", "qx", "qy", "polygon").distinct()
    dx, dy, ux, uy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py"), F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    across = dx * uy - dy * ux
    t = F.try_divide((F.col("ax") - F.col("px")) * uy - (F.col("ay") - F.col("py")) * ux, across)
    u = F.try_divide((F.col("ax") - F.col("px")) * dy - (F.col("ay") - F.col("py")) * dx, across)
    key = ["e_id", "k", "polygon", "px", "py", "qx", "qy"]
    cuts = near.join(sides(polygons), "polygon").groupBy(*key).agg(F.array_sort(F.collect_set(F.when((t > 0) & (t < 1) & (u >= 0) & (u <= 1), t))).alias("t"))
    cuts = cuts.withColumn("t", F.array_distinct(F.concat(F.array(F.lit(0.0)), "t", F.array(F.lit(1.0)))))
    pieces = cuts.select(*key, F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b"))).alias("z"))
    middle = (F.col("z.a") + F.col("z.b")) / 2
    pieces = checkpointed(pieces.select("e_id", "polygon", (F.col("px") + middle * dx).alias("x"), (F.col("py") + middle * dy).alias("y"), ((F.col("z.b") - F.col("z.a")) * F.hypot(dx, dy)).alias("length")).withColumn("id", F.monotonically_increasing_id()))
    inside = within(pieces.select("id", "x", "y"), polygons, cell)
    return pieces.join(inside, ["id", "polygon"]).groupBy("e_id", "polygon").agg(F.sum("length").alias("length"))


def label_inside(features: DataFrame, polygons: DataFrame, column: str = "urban") -> DataFrame:
    """Features (id, x, y) with 1 where any polygon holds them, else 0; a feature in several stays one row."""
    hit = within(features, polygons).select("id").distinct().withColumn("__in", F.lit(1))
    return features.join(hit, "id", "left").withColumn(column, F.coalesce("__in", F.lit(0))).drop("__in")


def line_length(vertices: Column) -> Column:
    ends = F.arrays_zip(F.slice(vertices, 1, F.size(vertices) - 1).alias("a"), F.slice(vertices, 2, F.size(vertices) - 1).alias("b"))
    return F.aggregate(ends, F.lit(0.0), lambda s, p: s + F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))


def hotspot(x: Column, y: Column, cx: float, cy: float, peak: float, radius: float) -> Column:
    """A synthetic intensity: a Gaussian around a centre."""
    return F.lit(peak) * F.exp(-(F.pow(x - cx, F.lit(2.0)) + F.pow(y - cy, F.lit(2.0))) / (2 * radius * radius))


def band(x: Column, y: Column, a: float, b: float, c: float, width: float, peak: float) -> Column:
    """A synthetic corridor: ``peak`` within ``width`` of the line a*x + b*y = c, 0 beyond."""
    d = F.abs(a * x + b * y - c) / float(np.hypot(a, b))
    return F.when(d <= width, F.lit(peak)).otherwise(F.lit(0.0))


def random_failures(key: Column, share: float, peak: float, seed: int) -> Column:
    """``peak`` for about ``share`` of the keys, by hash."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000, F.lit(peak)).otherwise(F.lit(0.0))
