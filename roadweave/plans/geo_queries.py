"""Queries of geometries, projections, rasters, further hazards and resumed builds, and the same in DuckDB's SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import geometry, projections
from ..operators import disruption, rasters
from ..operators.spatial import line_length
from ..session import shared_folder
from ..sources import tables as T
from ..streaming import builds
from .queries import query, r
from .stage_queries import _baseline

#: The conic system of the query below: the ellipsoid's eccentricity, and the projection's constants, by its published formulas.
_ALBERS = projections.SYSTEMS["EPSG:5070"]
_E, _N, _C, _ORIGIN = [f"{v!r}::DOUBLE" for v in _ALBERS._constants()]


@query(
    "projected_places",
    f"WITH q AS (SELECT id, lon, lat, sin(radians(lat)) AS s FROM cp), p AS (SELECT *, {_ALBERS.radius} * sqrt({_C} - {_N} * (1 - {_E} * {_E}) * (s / (1 - {_E} * {_E} * s * s) - ln((1 - {_E} * s) / (1 + {_E} * s)) / (2 * {_E}))) / {_N} AS rho, {_N} * radians(lon + 96) AS t FROM q) "
    f"SELECT id, round(rho * sin(t), 3) AS x, round({_ORIGIN} - rho * cos(t), 3) AS y, round({projections.SYSTEMS['EPSG:3857'].radius} * radians(lon), 3) AS web_x, round({projections.SYSTEMS['EPSG:3857'].radius} * ln(tan({math.pi / 4!r}::DOUBLE + radians(lat) / 2)), 3) AS web_y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM p",
    "cp",
)
def projected_places(s, d):
    """Customers' places in metres of two systems, and back in degrees from the first by way of the second."""
    lon, lat = F.col("lon"), F.col("lat")
    x, y = projections.transform(lon, lat, 4326, 5070)
    at = T.points(s, d, "customer").select("id", x.alias("x"), y.alias("y"))
    web_x, web_y = projections.transform(F.col("x"), F.col("y"), 5070, 3857)
    at = at.withColumns({"web_x": web_x, "web_y": web_y})
    back = projections.transform(F.col("web_x"), F.col("web_y"), 3857, 4326)
    return at.select("id", r("x", 3).alias("x"), r("y", 3).alias("y"), r("web_x", 3).alias("web_x"), r("web_y", 3).alias("web_y"), r(back[0], 8).alias("lon"), r(back[1], 8).alias("lat"))


@query(
    "decoded_lines",
    "SELECT id, 'LineString' AS kind, 9 + 48 AS bytes, round(sqrt(pow(id % 5, 2) + pow(id % 7, 2)) + sqrt(pow(id % 5, 2) + pow(1 - id % 7, 2)), 6) AS length FROM cp",
    "cp",
)
def decoded_lines(s, d):
    """A line at each customer's place as well-known binary, and its length from there."""
    vertex = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, k = F.col("lon"), F.col("lat"), F.col("id")
    lines = T.points(s, d, "customer").select("id", geometry.line(F.array(vertex(x, y), vertex(x + k % 5, y + k % 7), vertex(x, y + 1))).alias("geometry"))
    wkb = geometry.to_wkb(lines).withColumn("bytes", F.octet_length("geometry"))
    return T.with_geometry(wkb).select("id", F.col("geometry.kind").alias("kind"), "bytes", r(line_length(geometry.vertices(F.col("geometry"))), 6).alias("length"))


@query(
    "warped_grid",
    "WITH c AS (SELECT i, j, avg(intensity) AS v FROM sg GROUP BY 1, 2), t AS (SELECT a::INTEGER AS col, b::INTEGER AS row, (a + 0.5::DOUBLE) * 0.8 + 0.3 - 0.5 AS u, (b + 0.5::DOUBLE) * 0.8 + 0.1 - 0.5 AS v FROM range(60) x(a), range(45) y(b)), "
    "w AS (SELECT col, row, (floor(u) + p)::INTEGER AS i, (floor(v) + q)::INTEGER AS j, (CASE p WHEN 1 THEN u - floor(u) ELSE 1 - u + floor(u) END) * (CASE q WHEN 1 THEN v - floor(v) ELSE 1 - v + floor(v) END) AS w FROM t, (VALUES (0), (1)) m(p), (VALUES (0), (1)) n(q)) "
    "SELECT col, row, round(sum(w * c.v) / sum(CASE WHEN c.v IS NOT NULL THEN w END), 6) AS value FROM w LEFT JOIN c USING (i, j) WHERE w > 1e-9 GROUP BY 1, 2",
    "sg",
)
def warped_grid(s, d):
    """The segments' mean intensities by cell on a finer grid that is shifted against it."""
    cells = T.segments(s, d).select(F.col("i").alias("col"), F.col("j").alias("row"), F.col("intensity").alias("value"))
    out = rasters.warp(cells, (1, 0, 0, 0, 1, 0), (0.8, 0, 0.3, 0, 0.8, 0.1), 60, 45)
    return out.select("col", "row", r("value", 6).alias("value"))


#: A hazard of this module: gusts by their speed, with steps alike for all classes.
GUSTS = (1.0, 2.0, 3.0, 4.0)
WIND = disruption.Hazard("m_s_gust", "gust_max_m_s", 0.1, disruption.stepped(GUSTS), disruption.by_level)
disruption.register_hazard("wind", WIND)


@query(
    "registered_hazard",
    "WITH m AS (SELECT e_id, max(intensity) AS x FROM sg JOIN lk USING (e_id) GROUP BY 1), l AS (SELECT e_id, coalesce(x, 0) AS x, CASE WHEN x >= 4 THEN 4 WHEN x >= 3 THEN 3 WHEN x >= 2 THEN 2 WHEN x >= 1 THEN 1 ELSE 0 END AS n FROM lk LEFT JOIN m USING (e_id)) "
    "SELECT e_id, round(x, 6) AS gust, round(x * 0.1, 6) AS depth, (['no', 'minor', 'moderate', 'extensive', 'severe'])[n + 1] AS level, round(free * (CASE n WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.5 ELSE 0 END)::DOUBLE / free, 6)::DOUBLE AS share FROM l, (SELECT 50.0::DOUBLE AS free)",
    "sg lk",
)
def registered_hazard(s, d):
    """Links under a hazard that the library does not have of itself."""
    cells = T.segments(s, d).select("e_id", F.col("segment_id").alias("split_id"), "i", "j", F.col("intensity").alias("value"))
    out = disruption.run_disruption(T.links(s, d), {"gusts": cells}, _baseline(s, d), "wind", 0.0, "3", 801)
    return out.select("e_id", r("gust_max_m_s", 6).alias("gust"), r("flood_depth_max", 6).alias("depth"), F.col("damage_level_max").alias("level"), r(F.col("max_speed") / F.col("free_flow_speeds"), 6).alias("share"))


@query(
    "resumed_commuting",
    "SELECT sn.n_regionkey::VARCHAR AS origin, cn.n_regionkey::VARCHAR AS destination, 2022 AS year, 'JT00' AS job_type, count(*)::BIGINT AS jobs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2",
)
def resumed_commuting(s, d):
    """Commuters by a build in two runs: the main files first, then what came since."""
    read = lambda t: s.read.parquet(f"{d}/{t}.parquet")
    lookup = read("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("block"), F.col("n_regionkey").cast("string").alias("county"))
    line = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    blocks = line.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("w_geocode"), F.concat(F.lit("n"), "s_nationkey").alias("h_geocode")).agg(F.count("*").alias("S000"))
    folder = f"{shared_folder(s)}/commuters-{uuid.uuid4().hex}"
    same = F.col("w_geocode") == F.col("h_geocode")
    out = None
    for part, rows in (("main", blocks.where(same)), ("aux", blocks.where(~same))):
        rows.write.csv(f"{folder}/in/all_od_{part}_JT00_2022.csv", header=True)
        out = builds.build_counties(s, f"{folder}/in/*/part-*", lookup, f"{folder}/out", f"{folder}/state")
    return out
