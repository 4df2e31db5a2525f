import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions import geometry, projections
from roadweave.sources import tables

SHAPES = {
    "point": ("Point", [(0, [(1.5, -2.0)])]),
    "line": ("LineString", [(0, [(0.0, 0.0), (3.0, 4.0), (3.0, 5.0)])]),
    "hole": ("Polygon", [(0, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)]), (0, [(5.0, 1.0), (6.0, 1.0), (6.0, 2.0), (5.0, 1.0)])]),
    "points": ("MultiPoint", [(0, [(1.0, 1.0)]), (1, [(2.0, 2.0)])]),
    "lines": ("MultiLineString", [(0, [(0.0, 0.0), (1.0, 1.0)]), (1, [(2.0, 2.0), (3.0, 3.0), (4.0, 4.0)])]),
    "polygons": ("MultiPolygon", [(0, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]), (1, [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)]), (1, [(5.1, 5.1), (5.2, 5.1), (5.1, 5.2), (5.1, 5.1)])]),
    "nothing": ("MultiLineString", []),
    "empty": ("LineString", [(0, [])]),
}


def plain(g):
    return g and (g.kind, [(p.member, [(v.x, v.y) for v in p.vertices]) for p in g.parts])


def test_round_trip_of_all_kinds(spark):
    data = {k: geometry.build(kind, [(m, np.array(v, "f8").reshape(-1, 2)) for m, v in parts]) for k, (kind, parts) in SHAPES.items()}
    bad = {"cut": data["hole"][:-3], "more": data["line"] + b"x", "none": None, "no": b"", "kind": struct.pack("<BI", 1, 9) + b"\0" * 16}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in (data | bad).items()], "k string, wkb binary")
    read = geometry.from_wkb(df.select("k", "wkb", F.col("wkb").alias("g")), "g")
    out = geometry.to_wkb(read.select("*", F.col("g").alias("again")), "again").collect()
    for row in out:
        if row.k in bad:
            assert row.g is None and row.again is None, row.k
        else:
            assert plain(row.g) == SHAPES[row.k] and bytes(row.again) == bytes(row.wkb), row.k
    assert geometry.to_wkb(read.limit(0), "g").count() == 0


def test_extended_and_big_endian_forms(spark):
    big = struct.pack(">BII4d", 0, 2, 2, 1, 2, 3, 4)
    with_z = struct.pack("<BII6d", 1, 1002, 2, 1, 2, 9, 3, 4, 9)
    extended = struct.pack("<BIiI6d", 1, 0x80000002 | 0x20000000, 4326, 2, 1, 2, 9, 3, 4, 9)
    df = spark.createDataFrame([(bytearray(b),) for b in (big, with_z, extended)], "geometry binary")
    rows = tables.with_geometry(df).select("geometry").collect()
    assert [plain(r.geometry) for r in rows] == [("LineString", [(0, [(1.0, 2.0), (3.0, 4.0)])])] * 3
    assert [r.geometry.srid for r in rows] == [None, None, 4326]


def test_files_of_geometries(spark, tmp_path):
    def nest(kind, parts):
        runs = [[list(v) for v in run] for _, run in parts]
        if kind == "MultiPolygon":
            return [[r for (m, _), r in zip(parts, runs, strict=True) if m == i] for i in sorted({m for m, _ in parts})]
        return {"Point": lambda: runs[0][0], "LineString": lambda: runs[0], "MultiPoint": lambda: [r[0] for r in runs]}.get(kind, lambda: runs)()

    features = [{"type": "Feature", "properties": {"k": k, "n": 1}, "geometry": {"type": kind, "coordinates": nest(kind, parts)}} for k, (kind, parts) in SHAPES.items()]
    features.append({"type": "Feature", "properties": {"k": "none"}, "geometry": None})
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "a.geojsonl").write_text("\n".join(map(json.dumps, features)))
    for name in ("a.geojson", "a.geojsonl"):
        got = {r.properties["k"]: plain(r.geometry) for r in tables.read_table(spark, str(tmp_path / name)).collect()}
        assert got == SHAPES | {"none": None}, name
    df = tables.read_table(spark, str(tmp_path / "a.geojsonl")).select(F.col("properties")["k"].alias("k"), "geometry")
    geometry.to_wkb(df).write.parquet(str(tmp_path / "b.geoparquet"))
    got = {r.k: plain(r.geometry) for r in tables.read_table(spark, str(tmp_path / "b.geoparquet")).collect()}
    assert got == SHAPES | {"none": None}


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_published_control_points(spark):
    """The worked examples of Snyder's manual: Albers on Clarke's ellipsoid, and the azimuthal one on a sphere of radius 3."""
    clarke = projections.Albers(29.5, 45.5, 23.0, -96.0, 6378206.4, 1 / 294.978698214)
    x, y = values(spark, *clarke.forward(F.lit(-75.0), F.lit(35.0)))
    assert (round(x, 1), round(y, 1)) == (1885472.7, 1535925.0)
    x, y = values(spark, *projections.Azimuthal(40.0, -100.0, 3.0).forward(F.lit(100.0), F.lit(-20.0)))
    assert (round(x, 7), round(y, 7)) == (-4.2339303, 4.0257775)
    x, y = values(spark, *projections.SYSTEMS["EPSG:3857"].forward(F.lit(180.0), F.lit(0.0)))
    assert round(x, 3) == round(math.pi * 6378137, 3) and abs(y) < 1e-8


@pytest.mark.parametrize("code", sorted(projections.SYSTEMS))
def test_there_and_back(spark, code):
    df = spark.createDataFrame([(-124.7, 48.4), (-96.0, 23.0), (-66.9, 44.8), (-80.0, 25.1), (-100.0, 45.0), (-96.0, 80.0), (None, 1.0)], "lon double, lat double")
    x, y = projections.transform(F.col("lon"), F.col("lat"), 4326, code)
    df = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = projections.transform(F.col("x"), F.col("y"), code, "EPSG:4326")
    for r in df.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r.lon is None and r.lon2 is None or abs(r.lon - r.lon2) < 1e-10 and abs(r.lat - r.lat2) < 1e-10, (code, r)  # a hundredth of a millimetre


def test_names_of_systems(spark):
    assert projections.canonical(None) == projections.canonical("ESRI:102008") == projections.canonical("US National Atlas Equal Area") == projections.canonical(2163) == "EPSG:2163"
    assert projections.equivalent("epsg:900913", 3857) and projections.equivalent(None, None)
    assert not projections.equivalent(None, 2163) and not projections.equivalent(5070, 2163)
    with pytest.raises(KeyError):
        projections.transform(F.lit(1.0), F.lit(1.0), "EPSG:27700", 4326)
    line = F.array(F.struct(F.lit(-100.0).alias("x"), F.lit(45.0).alias("y")))
    assert [abs(v) < 1e-6 for p in spark.range(1).select(projections.transform_vertices(line, 4326, 2163).alias("v")).first().v for v in (p.x, p.y)] == [True, True]
