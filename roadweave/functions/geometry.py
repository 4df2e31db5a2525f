"""Geometry columns: well-known binary to lists of vertices and back (Arrow batches), and GeoJSON's coordinates by schema."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds by their number in well-known binary.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
#: Flags of a third and fourth coordinate and of an id of the coordinate system in the extended form.
Z_FLAG, M_FLAG, SRID_FLAG = 0x80000000, 0x40000000, 0x20000000
#: A geometry: its kind, the id of its coordinate system if stated, and its parts; ``member`` numbers the members of a multi-geometry.
_VERTICES = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_PARTS = T.ArrayType(T.StructType([T.StructField("member", T.IntegerType()), T.StructField("vertices", _VERTICES)]))
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("parts", _PARTS)])


def _header(data: memoryview, at: int) -> tuple[str, int, int, int | None, int]:
    """(byte order, kind, coordinates a vertex, srid, end of the header)."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    srid = None
    if code & SRID_FLAG:
        (srid,) = struct.unpack_from(order + "i", data, at)
        at += 4
    base = code & 0x0FFFFFFF
    more = {0: 0, 1: 1, 2: 1, 3: 2}[base // 1000] + bool(code & Z_FLAG) + bool(code & M_FLAG)
    return order, base % 1000, 2 + more, srid, at


def _vertices(data: memoryview, at: int, n: int, width: int, order: str) -> tuple[np.ndarray, int]:
    out = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2]
    return out.astype("f8"), at + 8 * n * width


def _simple(data: memoryview, at: int, member: int, parts: list[tuple[int, np.ndarray]]) -> tuple[int, int | None, int, int, str]:
    """Adds the parts of the point, line or polygon at ``at``; (kind, srid, end, members that follow, byte order)."""
    order, kind, width, srid, at = _header(data, at)
    if kind == 1:
        v, at = _vertices(data, at, 1, width, order)
        parts.append((member, v[~np.isnan(v).any(axis=1)]))  # an empty point has no numbers
        return kind, srid, at, 0, order
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == 2:
        v, at = _vertices(data, at, n, width, order)
        parts.append((member, v))
        return kind, srid, at, 0, order
    if kind == 3:
        for _ in range(n):
            (size,) = struct.unpack_from(order + "I", data, at)
            v, at = _vertices(data, at + 4, size, width, order)
            parts.append((member, v))
        return kind, srid, at, 0, order
    return kind, srid, at, n, order


def parse(data: bytes) -> tuple[str, int | None, list[tuple[int, np.ndarray]]]:
    """(kind, srid, [(member, vertices)]) of one geometry; third and fourth coordinates go. What is no such geometry raises ValueError."""
    view, parts = memoryview(data), []
    try:
        kind, srid, at, members, _ = _simple(view, 0, 0, parts)
        for i in range(members):
            inner, _, at, _, _ = _simple(view, at, i, parts)
            if inner != kind - 3:
                raise ValueError("a member of another kind")
        if kind not in KINDS or at != len(view):
            raise ValueError("no geometry, or bytes are left over")
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError("no well-known binary") from e
    return KINDS[kind], srid, parts


def build(kind: str, parts: list[tuple[int, np.ndarray]]) -> bytes:
    """The well-known binary of a geometry, little-endian, two coordinates a vertex. A kind that KINDS lacks raises ValueError."""
    code = next((n for n, name in KINDS.items() if name == kind), None)
    if code is None:
        raise ValueError(f"kind {kind}")
    head = lambda c: struct.pack("<BI", 1, c)
    flat = lambda v: np.ascontiguousarray(v, "<f8").tobytes()

    def simple(c: int, rings: list[np.ndarray]) -> bytes:
        if c == 1:
            return head(1) + flat(rings[0] if rings and len(rings[0]) else [[np.nan, np.nan]])
        if c == 2:
            v = rings[0] if rings else np.empty((0, 2))
            return head(2) + struct.pack("<I", len(v)) + flat(v)
        return head(3) + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(v)) + flat(v) for v in rings)

    if code <= 3:
        return simple(code, [v for _, v in parts])
    members: dict[int, list[np.ndarray]] = {}
    for m, v in parts:
        members.setdefault(m, []).append(v)
    return head(code) + struct.pack("<I", len(members)) + b"".join(simple(code - 3, members[m]) for m in sorted(members))


def _nested(rows: list[tuple[str, int | None, list[tuple[int, np.ndarray]]] | None]) -> pa.StructArray:
    """GEOMETRY's Arrow array of a batch: coordinates are joined once, lists are offsets into them."""
    parts = [p for row in rows if row for p in row[2]]
    xy = np.concatenate([v for _, v in parts]) if parts else np.empty((0, 2))
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    vertices = pa.ListArray.from_arrays(ends([len(v) for _, v in parts]), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]))
    part = pa.StructArray.from_arrays([pa.array([m for m, _ in parts], pa.int32()), vertices], ["member", "vertices"])
    lists = pa.ListArray.from_arrays(ends([len(row[2]) if row else 0 for row in rows]), part)
    kinds, srids = pa.array([row and row[0] for row in rows], pa.string()), pa.array([row and row[1] for row in rows], pa.int32())
    return pa.StructArray.from_arrays([kinds, srids, lists], ["kind", "srid", "parts"], mask=pa.array([row is None for row in rows]))


def _decoded(data: pa.Array) -> pa.Array:
    rows = []
    for b in data.cast(pa.binary()):
        try:
            rows.append(parse(b.as_buffer()) if b.is_valid else None)
        except ValueError:
            rows.append(None)
    return _nested(rows)


def _encoded(geometry: pa.Array) -> pa.Array:
    kinds, lists = geometry.field("kind").to_pylist(), geometry.field("parts")
    part = lists.values
    vertices = part.field("vertices")
    xy = np.stack([vertices.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    cuts, ends, member = vertices.offsets.to_numpy(), lists.offsets.to_numpy(), part.field("member").to_numpy(zero_copy_only=False)
    there = geometry.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([build(k, [(member[p], xy[cuts[p] : cuts[p + 1]]) for p in range(ends[i], ends[i + 1])]) if ok and k else None for i, (k, ok) in enumerate(zip(kinds, there, strict=True))], pa.binary())


def _replaced(df: DataFrame, column: str, kind: T.DataType, change: Callable[[pa.Array], pa.Array]) -> DataFrame:
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [change(c) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)


def from_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """The table with its column of well-known binary (plain, or with a srid, of 2 to 4 coordinates) as GEOMETRY. Null, cut off and other bytes give null."""
    return _replaced(df, column, GEOMETRY, _decoded)


def to_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """The table with its GEOMETRY column as well-known binary, little-endian and of two coordinates; null gives null, an empty geometry an empty one."""
    return _replaced(df, column, T.BinaryType(), _encoded)


def line(vertices: Column) -> Column:
    """A line as GEOMETRY."""
    return _of("LineString", F.array(_part(0, vertices)), vertices)


def point(x: Column, y: Column) -> Column:
    """A point as GEOMETRY; null if a coordinate is."""
    return _of("Point", F.array(_part(0, F.array(_vertex(x, y)))), x + y)


def polygon(rings: Column) -> Column:
    """A polygon as GEOMETRY: the outer ring first."""
    return _of("Polygon", F.transform(rings, lambda v: _part(0, v)), rings)


def vertices(geometry: Column) -> Column:
    """The vertices of all parts in order; of a line or a point its own."""
    return F.flatten(F.transform(geometry["parts"], lambda p: p["vertices"]))


def rings(geometry: Column) -> Column:
    """The vertices of each part."""
    return F.transform(geometry["parts"], lambda p: p["vertices"])


def _vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _part(member: int | Column, vertices: Column) -> Column:
    return F.struct((F.lit(member) if isinstance(member, int) else member).cast("int").alias("member"), vertices.alias("vertices"))


def _of(kind: str | Column, parts: Column, needed: Column) -> Column:
    return F.when(needed.isNotNull(), F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(None).cast("int").alias("srid"), parts.alias("parts")))


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """GEOMETRY of a GeoJSON geometry's type and the JSON text of its coordinates; other types and broken texts give null."""
    of = lambda depth: F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
    run = lambda c: F.transform(c, lambda v: _vertex(F.get(v, F.lit(0)), F.get(v, F.lit(1))))
    one = of(1)
    single = F.array(_part(0, F.array(_vertex(F.get(one, F.lit(0)), F.get(one, F.lit(1))))))
    members = lambda c, f: F.transform(c, lambda v, i: _part(i, f(v)))
    shapes = {
        "Point": (one, single),
        "LineString": (of(2), F.array(_part(0, run(of(2))))),
        "Polygon": (of(3), F.transform(of(3), lambda r: _part(0, run(r)))),
        "MultiPoint": (of(2), members(of(2), lambda v: F.array(_vertex(F.get(v, F.lit(0)), F.get(v, F.lit(1)))))),
        "MultiLineString": (of(3), members(of(3), run)),
        "MultiPolygon": (of(4), F.flatten(F.transform(of(4), lambda p, i: F.transform(p, lambda r: _part(i, run(r)))))),
    }
    out = F.lit(None).cast(GEOMETRY)
    for name, (needed, parts) in shapes.items():
        out = F.when(kind == name, _of(name, parts, needed)).otherwise(out)
    return out
