"""Points, polygons and lines against hand-worked cases and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import spatial

RING = "polygon string, ring array<struct<x: double, y: double>>"
POINT = "id long, x double, y double"
LINE = "e_id string, vertices array<struct<x: double, y: double>>"


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


SHAPES = {
    "a": [(0, 0), (4, 0), (4, 4), (0, 4)],
    "b": [(4, 0), (9, 0), (6, 3)],
    "c": [(-20.5, 30), (-14, 31), (-15, 40), (-18, 33)],
    "u": [(10, 10), (20, 10), (20, 20), (17, 20), (17, 13), (13, 13), (13, 20), (10, 20)],
}


def distance(x, y, shape):
    out = []
    for (ax, ay), (bx, by) in zip(shape, [*shape[1:], shape[0]]):
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        out.append(math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return min(out)


def inside(x, y, shape):
    odd = False
    for (ax, ay), (bx, by) in zip(shape, [*shape[1:], shape[0]]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [1.0, 7.0])
def test_JN28_JN31_points(spark, cell):
    rng = random.Random(5)
    pts = [(i, rng.uniform(-30, 30), rng.uniform(-10, 50)) for i in range(120)] + [(200, 300.0, -400.0), (201, 15.0, 16.0), (202, 4.5, 5.0), (203, 6.5, 5.0)]
    points = spark.createDataFrame([*pts, (204, None, 1.0)], POINT)
    polygons = spark.createDataFrame([(k, ring(*v)) for k, v in SHAPES.items()] + [("none", None), ("nothing", [])], RING)
    got = {(r.id, r.polygon) for r in spatial.within(points, polygons, cell).collect()}
    assert got == {(i, k) for i, x, y in pts for k, v in SHAPES.items() if inside(x, y, v)}
    near = {r.id: r.polygon for r in spatial.within_or_nearest(points, polygons, cell).collect()}
    want = {i: min([k for k, v in SHAPES.items() if inside(x, y, v)] or [min((round(distance(x, y, v), 9), k) for k, v in SHAPES.items())[1]]) for i, x, y in pts}
    assert near == want and want[201] == "u" and (201, "u") not in got
    assert spatial.within_or_nearest(points, polygons.limit(0)).count() == 0 and spatial.within_or_nearest(points.limit(0), polygons).count() == 0


def test_JN31_equal_distances_go_to_the_first_name(spark):
    """The gap between two boxes, whose middle is as far from both, however the distances are rounded."""
    polygons = spark.createDataFrame([("p2", ring((0, 0), (0.1, 0), (0.1, 1), (0, 1))), ("p1", ring((0.7, 0), (0.8, 0), (0.8, 1), (0.7, 1)))], RING)
    points = spark.createDataFrame([(1, 0.4, 0.5), (2, 0.39, 0.5), (3, 0.41, 0.5)], POINT)
    assert {r.id: r.polygon for r in spatial.within_or_nearest(points, polygons).collect()} == {1: "p1", 2: "p2", 3: "p1"}


def test_JN28_lines_are_clipped(spark):
    lines = spark.createDataFrame([
        ("through", ring((-2, 2), (12, 2))), ("bent", ring((1, 1), (1, 3), (3, 3), (3, 30))), ("over", ring((8, 16), (22, 16))), ("out", ring((50, 50), (60, 60))), ("point", ring((1, 1))), ("side", ring((13, 10), (13, 20))),
    ], LINE)
    polygons = spark.createDataFrame([(k, ring(*v)) for k, v in SHAPES.items()], RING)
    got = {(r.e_id, r.polygon): r.length for r in spatial.clip_lines(lines, polygons).collect()}
    assert got.pop(("through", "a")) == pytest.approx(4) and got.pop(("through", "b")) == pytest.approx(7 - 16 / 3)
    assert got.pop(("bent", "a")) == pytest.approx(2 + 2 + 1) and got.pop(("over", "u")) == pytest.approx(6)
    assert got.pop(("side", "u")) >= 3 and not got


def test_JN28_clips_add_up(spark):
    """Boxes that tile a square hold all of a line within it."""
    rng = random.Random(9)
    lines = [(f"l{i}", ring(*[(rng.uniform(0.01, 5.99), rng.uniform(0.01, 5.99)) for _ in range(rng.randint(2, 7))])) for i in range(12)]
    tiles = [(f"t{x}{y}", ring((x, y), (x + 2, y), (x + 2, y + 3), (x, y + 3))) for x in (0, 2, 4) for y in (0, 3)]
    df = spark.createDataFrame(lines, LINE)
    whole = {r.e_id: r.n for r in df.select("e_id", spatial.line_length(F.col("vertices")).alias("n")).collect()}
    got = {r.e_id: r.n for r in spatial.clip_lines(df, spark.createDataFrame(tiles, RING), 0.7).groupBy("e_id").agg(F.sum("length").alias("n")).collect()}
    assert got == pytest.approx(whole)


def test_GR10_links_are_split_at_points(spark):
    """Lengths add up, a point has links on both sides, cuts at ends and repeated ones cut nothing."""
    from roadweave.operators import network

    lines = spark.createDataFrame([("a", ring((0, 0), (4, 0), (4, 3))), ("b", ring((0, 10), (10, 10))), ("c", ring((20, 20), (21, 21)))], LINE)
    points = spark.createDataFrame([(1, 1.0, 0.3), (2, 4.2, 2.0), (3, 4.0, 0.0), (4, 5.0, 10.5), (5, 5.0, 9.9), (6, -1.0, 10.0), (7, 15.0, 15.0), (8, 1.0, -0.2)], POINT)
    links, nodes = network.network_of_parts(lines, points, 1.0)
    got = {r.e_id: [(round(p.x, 9), round(p.y, 9)) for p in r.vertices] for r in links.collect()}
    assert got == {
        "a_0": [(0, 0), (1, 0)], "a_1": [(1, 0), (4, 0)], "a_2": [(4, 0), (4, 2)], "a_3": [(4, 2), (4, 3)], "b_0": [(0, 10), (5, 10)], "b_1": [(5, 10), (10, 10)], "c": [(20, 20), (21, 21)],
    }
    rows = links.collect()
    degree = {}
    for row in rows:
        for n in (row.from_id, row.to_id):
            degree[n] = degree.get(n, 0) + 1
    assert degree[next(r.to_id for r in rows if r.e_id == "a_0")] == 2 and nodes.count() == len(degree) == 10
    snapped = {r.id: (r.e_id, round(r.place, 9)) for r in spatial.snap(points, lines, 1.0).collect()}
    assert snapped == {1: ("a", 0.25), 2: ("a", round(1 + 2 / 3, 9)), 3: ("a", 1.0), 4: ("b", 0.5), 5: ("b", 0.5), 6: ("b", 0.0), 8: ("a", 0.25)}
