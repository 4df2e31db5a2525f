"""Queries of whole stages: disruption, damage, county flows, crosswalks, networks, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cost, curves, damage, keys
from ..operators import damages, demand, disruption, network, report, spatial
from ..operators import incidence as inc
from ..sources import tables as T
from .queries import CURVE, DMG, _assigned, _damaged, _level_sql, query, r

KNOWN = ", ".join(f"'{c}'" for c in damage.DAMAGEABLE)
MAJOR = ", ".join(f"'{c}'" for c in cost.MAJOR_CLASSES)
OFFSET, CAP = 0.5, 60.0


def _cells(s, d):
    """Segments as cells by kind of flood; every fiftieth lies in no cell."""
    g = T.segments(s, d).withColumns({"split_id": F.col("segment_id"), "outside": F.col("segment_id") % 50 == 49, "value": F.col("intensity")})
    return g.withColumns({"i": F.when(F.col("outside"), -1).otherwise(F.col("i")), "j": F.when(F.col("outside"), -1).otherwise(F.col("j"))})


def _baseline(s, d):
    return T.links(s, d).select("e_id", F.lit(5.0).alias("acc_flow"), F.col("capacity").alias("acc_capacity"), F.when(F.col("suppkey") % 7 != 0, F.lit(CAP)).alias("free_flow_speeds"))


FREE = "CASE WHEN suppkey % 7 <> 0 THEN 60.0 ELSE 50.0 END"
_DEPTHS = f"WITH x AS (SELECT e_id, road_class, hazard, CASE WHEN lower(trim(road_class)) IN ({MAJOR}) THEN greatest(intensity - 0.5, 0) ELSE intensity END AS v FROM sg JOIN lk USING (e_id) WHERE segment_id % 50 <> 49)"
_NUMBER = "CASE l WHEN 'minor' THEN 1 WHEN 'moderate' THEN 2 WHEN 'extensive' THEN 3 WHEN 'severe' THEN 4 ELSE 0 END"
_NAME = "(['no', 'minor', 'moderate', 'extensive', 'severe'])[coalesce(n, 0) + 1]"


def flood_links(s, d):
    cells = _cells(s, d)
    parts = {h: cells.where(F.col("hazard") == h) for h in ("surface", "river")}
    return disruption.run_disruption(T.links(s, d), parts, _baseline(s, d), "flood", 30.0, "7", 301, OFFSET)


@query(
    "flood_disruption",
    f"{_DEPTHS}, y AS (SELECT e_id, v, CASE WHEN hazard = 'surface' THEN {_level_sql('surface', '(v * 100.0)')} ELSE {_level_sql('river', '(v * 100.0)')} END AS l FROM x), "
    f"m AS (SELECT e_id, max(v) AS v, max({_NUMBER}) AS n FROM y GROUP BY 1) "
    f"SELECT e_id, round(coalesce(v, 0), 6) AS depth, {_NAME} AS level, round(CASE WHEN coalesce(v, 0) * 100 < 30 THEN {FREE} * power(coalesce(v, 0) * 100 / 30 - 1, 2) ELSE 0 END, 6) AS max_speed, '7' AS event_id, 301 AS scenario_param, 'm_depth' AS unit, 5.0::DOUBLE AS acc_flow FROM lk LEFT JOIN m USING (e_id)",
    "sg lk",
)
def flood_disruption(s, d):
    out = flood_links(s, d)
    return out.select("e_id", r("flood_depth_max", 6).alias("depth"), F.col("damage_level_max").alias("level"), r("max_speed", 6).alias("max_speed"), "event_id", "scenario_param", F.col("intensity_unit").alias("unit"), "acc_flow")


def _intensity(hazard, scale, threshold, key):
    unit, column, to_depth = disruption.HAZARDS[hazard]
    quadratic = f"CASE WHEN coalesce(v, 0) < {threshold} THEN {FREE} * power(coalesce(v, 0) / {threshold} - 1, 2) ELSE 0 END"
    step = f"{FREE} * CASE coalesce(n, 0) WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.5 ELSE 0 END"
    cap = quadratic if hazard in disruption.BY_DEPTH else step

    @query(
        f"{hazard}_disruption",
        f"WITH x AS (SELECT e_id, road_class, intensity * {scale} AS v FROM sg JOIN lk USING (e_id) WHERE segment_id % 50 <> 49), y AS (SELECT e_id, v, {_level_sql(hazard, 'v')} AS l FROM x), m AS (SELECT e_id, max(v) AS v, max({_NUMBER}) AS n FROM y GROUP BY 1) "
        f"SELECT e_id, round(coalesce(v, 0), 6) AS intensity, round(coalesce(v, 0) * {to_depth}, 9) AS depth, {_NAME} AS level, round({cap}, 6)::DOUBLE AS max_speed FROM lk LEFT JOIN m USING (e_id)",
        "sg lk",
    )
    def run(s, d):
        cells = _cells(s, d).withColumn("value", F.col("intensity") * scale)
        out = disruption.run_disruption(T.links(s, d), {hazard: cells}, _baseline(s, d), hazard, threshold, "1", key)
        return out.select("e_id", r(column, 6).alias("intensity"), r("flood_depth_max", 9).alias("depth"), F.col("damage_level_max").alias("level"), r("max_speed", 6).alias("max_speed"))


for _h, _s, _t, _k in (("snow", 50.0, 150.0, 701), ("earthquake", 0.05, 25.0, 401), ("landslide", 20.0, 100.0, 501), ("winter_storm", 15.0, 100.0, 601)):
    _intensity(_h, _s, _t, _k)


@query("damaged_edges", f"{_DEPTHS}, y AS (SELECT e_id, CASE WHEN hazard = 'surface' THEN {_level_sql('surface', '(v * 100.0)')} ELSE {_level_sql('river', '(v * 100.0)')} END AS l FROM x) SELECT DISTINCT 'a-b_7' AS event_id, e_id FROM y WHERE l <> 'no'", "sg lk")
def damaged_edges(s, d):
    """Exported as a table of damaged links, loaded against the network: the event's name is made safe."""
    out = disruption.export_damaged(flood_links(s, d).withColumn("event_id", F.lit(" a-b 7 ")))
    return disruption.load_damaged(out.union(out.withColumn("e_id", F.lit("nowhere"))), T.links(s, d))


@query("merged_exposure", "SELECT e_id, segment_id AS split_id, i, j, round(max(CASE WHEN hazard = 'surface' THEN intensity END), 6) AS surface, round(max(CASE WHEN hazard = 'river' THEN intensity END), 6) AS river FROM sg WHERE segment_id % 50 <> 49 GROUP BY 1, 2, 3, 4", "sg")
def merged_exposure(s, d):
    cells = _cells(s, d)
    names = ["surface", "river"]
    out = disruption.only_cells(disruption.merge_exposures([cells.where(F.col("hazard") == n) for n in names], names))
    return out.select("e_id", "split_id", "i", "j", r("surface", 6).alias("surface"), r("river", 6).alias("river"))


KEYS = ("m_ge8_urb", "m_lt8_sub", "asingle_urb", "abdual_lt6_sub", "bsingle_sub", "bdual_lt6_urb", "Interstate", "US Route", "State Route", "Local")
CURVES = {f"C{n}": [(x, y * n / 6) for x, y in CURVE] for n in range(1, 7)}
_FRACTION = "CASE WHEN x <= 0 THEN 0 WHEN x <= 1 THEN x * 0.1 WHEN x <= 3 THEN 0.1 + (x - 1) * 0.15 WHEN x <= 6 THEN 0.4 + (x - 3) * 0.2 ELSE 1.0 END"


def _costs(s):
    roads = [(a, k, float(n), 2.0 * n) for a in ("road", "tunnel") for n, k in enumerate(KEYS, 1)]
    bridges = [(f"bridge_{t}", lv, float(n), 3.0 * n) for t in damages.TYPES for n, lv in enumerate(damage.LEVELS)]
    return s.createDataFrame(roads + bridges, "asset string, key string, low double, high double")


def _priced(s, d):
    g = _cells(s, d).join(T.links(s, d).select("e_id", "road_class"), "e_id").withColumn("length", F.lit(100.0) + F.col("segment_id") % 10)
    depth = F.round("intensity", 6)
    for t in damages.TYPES:
        one = F.when(F.col("hazard") == t, depth)
        g = g.withColumn(f"depth_{t}", one).withColumn(f"level_{t}", F.when(F.col("hazard") == t, damage.level_name(damage.class_ordinal(F.col("intensity"), t, F.col("road_class")))))
    k = F.col("suppkey")
    links = T.links(s, d).withColumns({"road_label": F.when(k % 5 == 0, "Bridge").when(k % 5 == 1, "tunnel").when(k % 5 == 2, "odd").otherwise("road"), "form_of_way": F.when(k % 3 == 0, "Single Carriageway").when(k % 3 == 1, "Dual Carriageway")})
    return damages.direct_damage(damages.damage_costs(damages.format_segments(g, links), _costs(s), CURVES))


_PAIRED = f"CASE WHEN cls IN ({MAJOR}) AND label = 'tunnel' THEN 1 WHEN cls IN ({MAJOR}) THEN 3 ELSE 5 END"
_KEY = f"""CASE WHEN cls IN ('motorway', 'motorway_link') THEN concat('m_', CASE WHEN lanes >= 8 THEN 'ge8' ELSE 'lt8' END, '_', place)
  WHEN cls IN ('trunk', 'primary', 'secondary') AND form = 'Single Carriageway' THEN concat('asingle_', place) WHEN cls IN ('trunk', 'primary', 'secondary') THEN concat('abdual_', CASE WHEN lanes >= 6 THEN 'ge6' ELSE 'lt6' END, '_', place)
  WHEN form = 'Single Carriageway' THEN concat('bsingle_', place) ELSE concat('bdual_', CASE WHEN lanes >= 6 THEN 'ge6' ELSE 'lt6' END, '_', place) END"""
_FALL = "CASE WHEN cls IN ('motorway', 'motorway_link', 'trunk', 'interstate') THEN 'Interstate' WHEN cls IN ('primary', 'secondary', 'us route') THEN 'US Route' WHEN cls IN ('tertiary', 'service', 'state route') THEN 'State Route' ELSE 'Local' END"
_LIST = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
DAMAGE_SQL = f"""WITH a AS (
  SELECT e_id, i, j, 100.0::DOUBLE + segment_id % 10 AS length, road_class, lanes, urban, suppkey,
    CASE WHEN hazard = 'surface' THEN round(intensity, 6) ELSE 0 END AS ds, CASE WHEN hazard = 'river' THEN round(intensity, 6) ELSE 0 END AS dr,
    CASE WHEN hazard = 'surface' THEN {_level_sql('surface', '(intensity * 100.0)')} ELSE 'no' END AS ls, CASE WHEN hazard = 'river' THEN {_level_sql('river', '(intensity * 100.0)')} ELSE 'no' END AS lr
  FROM sg JOIN lk USING (e_id) WHERE segment_id % 50 <> 49),
b AS (SELECT e_id, i, j, length, max(ds) AS ds, max(dr) AS dr, max({_NUMBER.replace('CASE l', 'CASE ls')}) AS ns, max({_NUMBER.replace('CASE l', 'CASE lr')}) AS nr, any_value(lower(trim(road_class))) AS cls, any_value(lanes) AS lanes,
    any_value(CASE WHEN urban = 1 THEN 'urb' ELSE 'sub' END) AS place, any_value(CASE suppkey % 5 WHEN 0 THEN 'bridge' WHEN 1 THEN 'tunnel' ELSE 'road' END) AS label,
    any_value(CASE WHEN suppkey % 3 = 1 THEN 'Dual Carriageway' ELSE 'Single Carriageway' END) AS form FROM a GROUP BY 1, 2, 3, 4),
c AS (SELECT *, {_PAIRED} AS p, list_position({_LIST}, {_KEY}) AS k1, list_position({_LIST}, {_FALL}) AS k2 FROM b),
e AS (SELECT *, coalesce(k1, k2) AS unit, {_FRACTION.replace('x', 'ds')} AS fs, {_FRACTION.replace('x', 'dr')} AS fr FROM c),
f AS (SELECT *, CASE WHEN label = 'bridge' THEN 3.65 * length * ns * 2 ELSE length * 1e-3 * lanes * unit * 1.5 * fs * (2 * p + 1) / 12 END AS s, CASE WHEN label = 'bridge' THEN 3.65 * length * nr * 2 ELSE length * 1e-3 * lanes * unit * 1.5 * fr * (2 * p + 1) / 12 END AS r FROM e)
"""


@query("damage_ladder", DAMAGE_SQL + "SELECT e_id, i, j, length, label, p AS pair, round(fs * p / 6 * 0.7310585786, 6) AS part_fraction, round((s + r) * 0.7310585786, 4) AS part_musd FROM f", "sg lk")
def damage_ladder(s, d):
    out = _priced(s, d)
    return out.select("e_id", "i", "j", "length", F.col("road_label").alias("label"), F.col("pair_surface").alias("pair"), r(F.col("fraction_surface_a") * 0.7310585786, 6).alias("part_fraction"), r(F.col("direct_damage_musd") * 0.7310585786, 4).alias("part_musd"))


@query("event_damage_table", DAMAGE_SQL + "SELECT '9' AS event_id, count(*) AS segments, count(DISTINCT e_id) AS links, round(sum((s + r) * 1e6), -1) AS damage, round(sum((s + r) * 1e6), -1) AS damage_high, round(sum(2 * (s + r)), 3) AS means FROM f", "sg lk")
def event_damage_table(s, d):
    p = _priced(s, d).withColumn("event_id", F.lit("9"))
    out = damages.event_summary(p, means=F.sum(damages.all_means(p)))
    return out.select("event_id", "segments", "links", r("damage", -1).alias("damage"), r("damage_high", -1).alias("damage_high"), r("means", 3).alias("means"))


# The mix of 0.4 of CURVE and 0.6 of the same stretched to twice the depth.
_MIXED = [(0.0, 0.0), (1.0, 0.07), (2.0, 0.16), (3.0, 0.265), (6.0, 0.64), (12.0, 1.0)]
_ON_MIXED = " ".join(f"WHEN intensity <= {x1} THEN {y0} + (intensity - {x0}) * {(y1 - y0) / (x1 - x0)!r}" for (x0, y0), (x1, y1) in zip(_MIXED, _MIXED[1:]))


@query("curve_tools", f"SELECT segment_id, round(CASE WHEN intensity <= 0 THEN 0 {_ON_MIXED} ELSE 1.0 END, 9)::DOUBLE AS fraction FROM sg", "sg")
def curve_tools(s, d):
    """Damage fractions of all segments on a mix of a curve and the same stretched."""
    mixed = curves.mixed(CURVE, curves.scaled(CURVE, 2.0), 0.4)
    return T.segments(s, d).select("segment_id", r(damage.fraction(F.col("intensity"), mixed), 9).alias("fraction"))


@query("speed_by_depth", "SELECT segment_id, round(greatest(0, least(50.0, 50.0 * (1 - intensity / 4.0))), 6) AS speed FROM sg", "sg")
def speed_by_depth(s, d):
    return T.segments(s, d).select("segment_id", r(curves.speed_left(F.col("intensity"), 50.0, 4.0), 6).alias("speed"))


_TEN = "CASE WHEN s_nationkey % 2 = 0 THEN 'sctg0109' ELSE 'sctg1014' END"
_GROUP = "CASE WHEN sctg <= 9 THEN 'sctg0109' WHEN sctg <= 14 THEN 'sctg1014' WHEN sctg <= 19 THEN 'sctg1519' WHEN sctg <= 33 THEN 'sctg2033' ELSE 'sctg3499' END"


def _regional(s, d, **kw):
    z = T.zone_flows(s, d).withColumnsRenamed({"origin_zone": "dms_orig", "destination_zone": "dms_dest", "sctg": "sctg2", "mode": "dms_mode", "tons": "tons_2022", "value": "value_2022"}).drop("year")
    z = z.withColumn("dms_orig", F.concat(F.lit("0"), F.col("dms_orig").cast("string")))
    return demand.regional_flows(z, 2022, **kw)


@query("regional_flows", f"SELECT origin_zone::VARCHAR AS origin_zone, destination_zone::VARCHAR AS destination_zone, {_GROUP} AS \"group\", count(*) AS n, round(sum(tons) * 1000, 1) AS tons, round(sum(value), 1) AS value FROM zf WHERE mode = 1 AND (origin_zone IN (1, 3) OR destination_zone IN (1, 3)) AND tons > 0 GROUP BY 1, 2, 3", "zf")
def regional_flows(s, d):
    """Trucks that start or end in two zones, in tons, whatever the columns are called."""
    out = _regional(s, d, zones=["01", "3"])
    return out.groupBy("origin_zone", "destination_zone", "group").agg(F.count("*").alias("n"), r(F.sum("tons"), 1).alias("tons"), r(F.sum("value"), 1).alias("value"))


def _group_factors(s, d, side):
    """Factors of all zones but 4, for one group that the flows have by zone's nation, doubled by group."""
    f = T.nation_factors(s, d, side).where("zone <> 4")
    two = f.crossJoin(s.createDataFrame([("sctg0109",), ("sctg2033",)], "group string"))
    return two.withColumns({"zone": F.col("zone").cast("string"), "county": F.col("county").cast("string")})


_GROUPED = f"g AS (SELECT origin_zone::VARCHAR AS origin_zone, destination_zone::VARCHAR AS destination_zone, {_GROUP} AS grp, tons * 1000 AS tons, value FROM zf WHERE mode = 1), two(grp) AS (VALUES ('sctg0109'), ('sctg2033')), o AS (SELECT zone::VARCHAR AS zone, county::VARCHAR AS county, factor, grp FROM fs, two WHERE zone <> 4), e AS (SELECT zone::VARCHAR AS zone, county::VARCHAR AS county, factor, grp FROM fc, two WHERE zone <> 4)"


def _county(how, name):
    left = "LEFT " if how else ""

    @query(
        name,
        f"WITH {_GROUPED} SELECT origin_zone, destination_zone, g.grp AS \"group\", o.county AS origin, e.county AS destination, '1' AS mode, 2022 AS year, round(sum(tons * o.factor * e.factor), 2) AS tons, round(sum(value * o.factor * e.factor), 2) AS value "
        f"FROM g {left}JOIN o ON o.zone = origin_zone AND o.grp = g.grp {left}JOIN e ON e.zone = destination_zone AND e.grp = g.grp GROUP BY ALL",
        "zf fs fc",
    )
    def run(s, d):
        """Seven keys; zones and groups without factors are dropped or kept without county."""
        out = demand.county_flows(_regional(s, d), _group_factors(s, d, "supplier"), _group_factors(s, d, "customer"), how)
        return out.select(*demand.FLOW_KEYS, *demand.PAIR, r("tons", 2).alias("tons"), r("value", 2).alias("value"))


_county(False, "county_flows")
_county(True, "county_flows_kept")


@query(
    "disaggregation_quality",
    f"WITH {_GROUPED}, c AS (SELECT origin_zone, destination_zone, g.grp, o.county AS a, e.county AS b, sum(tons * o.factor * e.factor) AS tons FROM g JOIN o ON o.zone = origin_zone AND o.grp = g.grp JOIN e ON e.zone = destination_zone AND e.grp = g.grp GROUP BY ALL), "
    "t AS (SELECT (SELECT sum(tons) FROM g) AS x, (SELECT sum(tons) FROM c) AS y) "
    "SELECT round(x, 1) AS tons_before, round(y, 1) AS tons_after, (SELECT count(*) FROM g) AS records, (SELECT count(*) FROM c) AS county_records, (SELECT count(*) FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.zone = origin_zone AND o.grp = g.grp)) AS missing_origin, "
    "(SELECT count(*) FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.zone = destination_zone AND e.grp = g.grp)) AS missing_destination, (SELECT count(*) FROM (SELECT DISTINCT origin_zone, destination_zone, grp FROM g EXCEPT SELECT DISTINCT origin_zone, destination_zone, grp FROM c)) AS dropped, round((y - x) * 100 / x, 6) AS difference_percent FROM t",
    "zf fs fc",
)
def disaggregation_quality(s, d):
    flows, o, e = _regional(s, d), _group_factors(s, d, "supplier"), _group_factors(s, d, "customer")
    out = demand.disaggregation_quality(flows, demand.county_flows(flows, o, e), o, e)
    return out.withColumns({"tons_before": r("tons_before", 1), "tons_after": r("tons_after", 1), "difference_percent": r("difference_percent", 6)})


@query("zone_weights", "WITH w AS (SELECT n_regionkey AS zone, CASE WHEN s_nationkey % 2 = 0 THEN 'a' ELSE 'all' END AS commodity, s_nationkey AS subarea, count(*) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 OR s_nationkey % 2 = 0 GROUP BY 1, 2, 3), k AS (SELECT r_regionkey AS zone, c AS commodity FROM region, (VALUES ('a'), ('b')) t(c)), e AS (SELECT k.zone, k.commodity, subarea, weight FROM k JOIN w USING (zone, commodity)), f AS (SELECT k.zone, k.commodity, subarea, weight FROM k LEFT JOIN w ON w.zone = k.zone AND w.commodity = 'all' WHERE (k.zone, k.commodity) NOT IN (SELECT (zone, commodity) FROM e)) SELECT zone, commodity, subarea, round(weight / sum(weight) OVER (PARTITION BY zone, commodity), 6) AS share FROM (SELECT * FROM e UNION ALL SELECT * FROM f)")
def zone_weights(s, d):
    sup = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = sup.select(F.col("n_regionkey").alias("zone"), F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("all").alias("commodity"), F.col("s_nationkey").alias("subarea"))
    w = w.where("zone <> 2 OR subarea % 2 = 0").groupBy("zone", "commodity", "subarea").agg(F.count("*").alias("weight"))
    wanted = s.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("zone"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("commodity"))
    return demand.zone_weights(w, wanted).select("zone", "commodity", "subarea", r("share", 6).alias("share"))


@query("whole_trucks", "SELECT origin_zone, destination_zone, sctg, greatest(1, round_even(sum(tons) / 20 / 365, 0))::BIGINT AS trucks FROM zf GROUP BY 1, 2, 3", "zf")
def whole_trucks(s, d):
    z = T.zone_flows(s, d).groupBy("origin_zone", "destination_zone", "sctg").agg(F.sum("tons").alias("tons"))
    return z.select("origin_zone", "destination_zone", "sctg", demand.whole_trucks(F.col("tons")).alias("trucks"))


_HAV = "2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query(
    "centroid_crosswalk",
    "WITH z AS (SELECT lpad(id::VARCHAR, 5, '0') AS zone, lon, lat FROM cp UNION ALL SELECT '99999', NULL, NULL), c AS (SELECT lpad((id * 3 + 1)::VARCHAR, 5, '0') AS zone, id * 3 + 1 AS centroid, concat('n', id) AS node, lon, lat FROM np), "
    f"p AS (SELECT z.zone, centroid, node, {_HAV.format(a='z', b='c')} AS m, c.zone AS cz FROM z, c WHERE z.lon IS NOT NULL AND z.zone NOT IN (SELECT zone FROM c)), b AS (SELECT zone, arg_min(centroid, (m, cz)) AS centroid, arg_min(node, (m, cz)) AS node, min(m) AS m FROM p GROUP BY 1) "
    "SELECT z.zone, coalesce(c.centroid, b.centroid) AS centroid, coalesce(c.node, b.node) AS node, CASE WHEN c.zone IS NOT NULL THEN 'exact_match' WHEN b.zone IS NOT NULL THEN 'nearest_loading_node' END AS method, CASE WHEN c.zone IS NOT NULL THEN 0 ELSE round(m, 4) END AS miles, "
    "CASE WHEN coalesce(c.zone, b.zone) IS NULL THEN 'unmapped' WHEN c.zone IS NULL AND m > 50 THEN 'distance_gt_50_miles' WHEN c.zone IS NULL AND m > 25 THEN 'distance_gt_25_miles' ELSE '' END AS warning FROM z LEFT JOIN c ON c.zone = z.zone LEFT JOIN b ON b.zone = z.zone",
    "cp np",
)
def centroid_crosswalk(s, d):
    """Zones whose id is a centroid's take it, the rest the nearest; one zone has no place."""
    z = T.points(s, d, "customer").select(F.col("id").cast("string").alias("zone"), "lon", "lat")
    more = s.createDataFrame([("99999", None, None)], "zone string, lon double, lat double")
    c = T.points(s, d, "nation").select((F.col("id") * 3 + 1).alias("centroid"), F.concat(F.lit("n"), "id").alias("node"), "lon", "lat")
    out = demand.crosswalk(z.union(more).select("zone"), c, z.union(more))
    return out.withColumn("miles", r("miles"))


_TURN = "(lon + 200 + 540) - 360 * floor((lon + 200 + 540) / 360) - 180"


@query("nearest_over_the_date_line", f"WITH a AS (SELECT id, {_TURN} AS lon, lat FROM cp), b AS (SELECT id, {_TURN} AS lon, lat FROM np), p AS (SELECT a.id, b.id AS near_id, {_HAV.format(a='a', b='b')} AS m FROM a, b) SELECT id, arg_min(near_id, (m, near_id)) AS near_id, round(min(m), 4) AS miles FROM p GROUP BY 1", "cp np")
def nearest_over_the_date_line(s, d):
    """The points turned by 200 degrees, so that they lie on both sides of the meridian at 180."""
    turn = lambda df: df.select("id", (F.pmod(F.col("lon") + 200 + 540, F.lit(360.0)) - 180).alias("lon"), "lat")
    return demand.nearest(turn(T.points(s, d, "customer")), turn(T.points(s, d, "nation"))).withColumn("miles", r("miles"))


@query("commuter_parts", "SELECT sn.n_regionkey AS origin, cn.n_regionkey AS destination, 2022 AS year, 'JT00' AS job_type, count(*)::BIGINT AS jobs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2")
def commuter_parts(s, d):
    """The main part, of homes and workplaces in one region, and the auxiliary one of all others."""
    nation = s.read.parquet(f"{d}/nation.parquet")
    lookup = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("block"), F.col("n_regionkey").alias("county"))
    line = s.read.parquet(f"{d}/lineitem.parquet").join(s.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(s.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).join(s.read.parquet(f"{d}/supplier.parquet"), F.col("l_suppkey") == F.col("s_suppkey"))
    blocks = line.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("home"), F.concat(F.lit("n"), "c_nationkey").alias("work")).agg(F.count("*").alias("jobs"))
    same = F.col("home") == F.col("work")
    return demand.commuter_counties([blocks.where(same), blocks.where(~same)], lookup, 2022)


@query("commuter_trips", "SELECT origin, destination, flow AS daily_trips, flow * 365 AS annual_trips FROM (SELECT origin, destination, round(sum(flow), 0) AS flow FROM nod GROUP BY 1, 2)", "nod")
def commuter_trips(s, d):
    jobs = T.nation_od(s, d).groupBy("origin", "destination").agg(r(F.sum("flow"), 0).alias("jobs"))
    return demand.commuter_trips(jobs)


@query("freight_passenger_split", "WITH t AS (SELECT origin, destination, sum(flow) * 2 AS f FROM nod GROUP BY 1, 2) SELECT 'freight' AS part, origin, destination, round(f * 0.3, 4) AS flow FROM t UNION ALL SELECT 'passenger', origin, destination, round(f * 0.7, 4) FROM t", "nod")
def freight_passenger_split(s, d):
    a, b = demand.scaled_split(T.nation_od(s, d), 2.0, 0.3)
    return a.select(F.lit("freight").alias("part"), "origin", "destination", r("flow").alias("flow")).union(b.select(F.lit("passenger"), "origin", "destination", r("flow")))


@query("origin_lists", "SELECT origin, string_agg(destination, ',' ORDER BY destination) AS destinations, round(sum(flow), 4) AS flow, count(*)::INTEGER AS n FROM (SELECT origin, destination, sum(flow) AS flow FROM nod GROUP BY 1, 2) GROUP BY 1", "nod")
def origin_lists(s, d):
    out = inc.origin_lists(demand.normalise(T.nation_od(s, d)))
    return out.select("origin", F.array_join("destinations", ",").alias("destinations"), r(F.aggregate("flows", F.lit(0.0), lambda a, x: a + x)).alias("flow"), F.size("flows").alias("n"))


@query("isolation_summary", "SELECT origin, destination, round(sum(flow), 4) AS flow FROM nod WHERE origin <> destination AND kind = 'freight' GROUP BY 1, 2 HAVING sum(flow) > 0", "nod")
def isolation_summary(s, d):
    return inc.isolation(T.nation_od(s, d).where("kind = 'freight'")).withColumn("flow", r("flow"))


@query("od_totals", "SELECT count(*) AS rows, count(DISTINCT origin) AS origins, count(DISTINCT destination) AS destinations, round(sum(flow), 3) AS flow, (SELECT count(*) FROM (SELECT 1 FROM nod GROUP BY origin, destination HAVING count(*) > 1)) AS repeated_pairs FROM nod", "nod")
def od_totals(s, d):
    od = T.nation_od(s, d)
    one = od.agg(F.count("*").alias("rows"), F.countDistinct("origin").alias("origins"), F.countDistinct("destination").alias("destinations"), r(F.sum("flow"), 3).alias("flow"))
    return one.crossJoin(report.repeated_pairs(od))  # one row each


@query("class_counts", "SELECT CASE WHEN lower(trim(road_class)) IN ('', 'nan', 'none', 'null') THEN 'unclassified' ELSE lower(trim(road_class)) END AS road_class, count(*) AS n FROM lk GROUP BY 1", "lk")
def class_counts(s, d):
    return report.value_counts(network.normalise_links(T.links(s, d)), "road_class")


@query("weighted_distance", "SELECT destination AS zone, round(sum(flow * n) / sum(flow), 6) AS mean_links, round(sum(flow), 4) AS flow FROM (SELECT od_id, any_value(destination) AS destination, any_value(flow) AS flow, count(*) AS n FROM st GROUP BY 1) GROUP BY 1", "st")
def weighted_distance(s, d):
    p = T.od_paths(s, d).select(F.col("destination").alias("zone"), "flow", F.size("path").alias("mean_links"))
    return demand.weighted_mean(p, ["zone"], "mean_links", "flow").select("zone", r("mean_links", 6).alias("mean_links"), r("flow").alias("flow"))


@query("volume_ratio", "SELECT e_id, round(total_flow / CASE WHEN suppkey % 4 = 0 THEN 100.0 ELSE lk.capacity END, 6) AS ratio FROM tot JOIN lk USING (e_id)", "tot lk")
def volume_ratio(s, d):
    links = T.links(s, d).select("e_id", F.when(F.col("suppkey") % 4 != 0, F.col("capacity")).otherwise(0.0).alias("capacity"))
    t = inc.edge_totals(inc.incidence(T.od_paths(s, d)), links)
    return t.select("e_id", r(report.volume_ratio(F.col("total_flow"), F.col("capacity"), F.lit(100.0)), 6).alias("ratio"))


@query("edge_totals_without_caps", "SELECT e_id, round(total_flow, 6) AS total_flow, CASE WHEN suppkey % 4 <> 0 THEN round(tot.capacity, 6) END AS capacity FROM tot JOIN lk USING (e_id)", "tot lk")
def edge_totals_without_caps(s, d):
    """A link that the table of capacities lacks keeps its flow."""
    caps = T.links(s, d).where("suppkey % 4 <> 0")  # the missing rows are the case under test
    return inc.edge_totals(inc.incidence(T.od_paths(s, d)), caps).select("e_id", r("total_flow", 6).alias("total_flow"), r("capacity", 6).alias("capacity"))


@query("disrupted_pairs", f"{DMG}, c AS (SELECT event, od_id, any_value(origin) AS o, any_value(destination) AS e, any_value(flow) - min(capacity) / 1000 AS f FROM st JOIN dm USING (e_id) JOIN lk USING (e_id) GROUP BY 1, 2) SELECT event, count(DISTINCT (o, e)) AS pairs, round(sum(f), 4) AS disrupted FROM c WHERE f > 0 GROUP BY 1", "st lk sg")
def disrupted_pairs(s, d):
    paths = T.od_paths(s, d)
    cap = T.links(s, d).select("e_id", (F.col("capacity") / 1000).alias("capacity"))
    lost = inc.disrupted_paths(paths, _damaged(s, d), cap, ["origin", "destination"])
    return inc.disrupted_by_pair(lost).withColumn("disrupted", r("disrupted"))


@query("scenario_summary", DAMAGE_SQL.rstrip() + f", m AS (SELECT e_id, v, n FROM ({_DEPTHS}, y AS (SELECT e_id, v, CASE WHEN hazard = 'surface' THEN {_level_sql('surface', '(v * 100.0)')} ELSE {_level_sql('river', '(v * 100.0)')} END AS l FROM x) SELECT e_id, max(v) AS v, max({_NUMBER}) AS n FROM y GROUP BY 1)), dd AS (SELECT sum((s + r) * 1e6) AS usd FROM f) SELECT '7' AS event_id, (SELECT count(*) FROM lk) AS links, count_if(v > 0)::BIGINT AS met, count_if(v * 100 >= 30)::BIGINT AS closed, count_if(n > 0)::BIGINT AS damaged, round(max(v), 6) AS deepest, round(any_value(usd), -1) AS direct_damage, round(any_value(usd) + 12.5, -1) AS combined, '' AS problems FROM m, dd", "sg lk")
def scenario_summary(s, d):
    links = flood_links(s, d)
    cost_of = damages.event_summary(_priced(s, d).withColumn("event_id", F.lit("7")))
    lost = s.createDataFrame([], "event_id string, origin string, destination string, disrupted double")
    out = report.scenario_summary(links, disruption.depth_equivalent(links), cost_of, lost, {"freight": 10.0, "passenger": 2.5})
    problems = report.check_summary(out).withColumn("problems", F.array_join("problems", ","))
    return out.join(problems, "event_id").select("event_id", "links", "met", "closed", "damaged", r("deepest", 6).alias("deepest"), r("direct_damage", -1).alias("direct_damage"), r("combined", -1).alias("combined"), "problems")


@query("flow_comparison", "WITH a AS (SELECT e_id, from_id, to_id, weight AS flow FROM net), b AS (SELECT from_id, to_id, sum(weight * 2) AS o FROM net WHERE weight > 5 GROUP BY 1, 2) SELECT e_id, round(coalesce(o, 0), 4) AS other_flow, round(flow - coalesce(o, 0), 4) AS difference FROM a LEFT JOIN b USING (from_id, to_id)", "net")
def flow_comparison(s, d):
    net = T.nation_net(s, d)
    other = net.where("weight > 5").select("from_id", "to_id", (F.col("weight") * 2).alias("flow"))
    return report.compare_flows(net.withColumnRenamed("weight", "flow"), other).select("e_id", r("other_flow").alias("other_flow"), r("difference").alias("difference"))


@query("benchmark_comparison", "WITH t AS (SELECT road_label AS event_id, sum(damage) AS total FROM sg GROUP BY 1), b AS (SELECT event_id, 1000.0::DOUBLE AS expected FROM t UNION ALL SELECT 'none', 5.0) SELECT event_id, expected, round(total, 2) AS total, round((total - expected) * 100 / expected, 4) AS error_percent FROM b LEFT JOIN t USING (event_id)", "sg")
def benchmark_comparison(s, d):
    totals = T.segments(s, d).groupBy(F.col("road_label").alias("event_id")).agg(F.sum("damage").alias("total"))
    bench = totals.select("event_id", F.lit(1000.0).alias("expected")).union(s.createDataFrame([("none", 5.0)], "event_id string, expected double"))
    return report.against_benchmark(bench, totals).withColumns({"total": r("total", 2), "error_percent": r("error_percent")})


_CODES = "[1, 2, 3, 5, 6, 7, 8, 9, 11, 14, 16, 41, 50, 99]"


def _coded(s, d):
    k = F.col("s_suppkey")
    at = lambda i: F.struct((k % 10 + i).cast("double").alias("x"), (k % 7 + i).cast("double").alias("y"))
    codes = F.array(*[F.lit(c) for c in (1, 2, 3, 5, 6, 7, 8, 9, 11, 14, 16, 41, 50, 99)])
    return s.read.parquet(f"{d}/supplier.parquet").select(
        k.alias("ID"), F.element_at(codes, (k % 14 + 1).cast("int")).alias("Class"), F.when(k % 5 == 0, "Own name").when(k % 5 == 1, " ").alias("Class_Description"), (F.col("s_acctbal") / 100 + 100).cast("double").alias("LENGTH"),
        F.when(k % 3 != 0, k % 6 + 1).alias("AB_Lanes"), F.when(k % 4 != 0, k % 5 + 1).alias("BA_Lanes"), F.when(k % 2 == 0, 99999).otherwise(7).alias("Urban_Code"), F.when(k % 3 == 0, "VA").otherwise("MD").alias("STATE"), F.array(at(0), at(1)).alias("vertices"),
    )


@query(
    "converted_links",
    f"WITH a AS (SELECT s_suppkey AS k, ({_CODES})[s_suppkey % 14 + 1] AS c, s_acctbal FROM supplier), b AS (SELECT *, CASE WHEN c IN (1, 11) THEN 'motorway' WHEN c = 2 THEN 'trunk' WHEN c IN (3, 14) THEN 'primary' WHEN c = 5 THEN 'secondary' WHEN c = 6 THEN 'tertiary' WHEN c = 8 THEN 'motorway_link' WHEN c IN (9, 16, 41) THEN 'service' ELSE 'unclassified' END AS road, "
    "CASE c WHEN 1 THEN 'Interstate' WHEN 2 THEN 'Principal Arterial - Freeways and Expressways' WHEN 3 THEN 'Principal Arterial - Other' WHEN 5 THEN 'Major Collector' WHEN 6 THEN 'Minor Collector' WHEN 7 THEN 'Local' WHEN 8 THEN 'Ramp' WHEN 9 THEN 'Service/Frontage Road' WHEN 11 THEN 'Interstate Highway' WHEN 14 THEN 'Arterial or Major Collector' WHEN 16 THEN 'Frontage/Service Road' WHEN 41 THEN 'Ferry' END AS label, "
    "coalesce(greatest(CASE WHEN k % 3 <> 0 THEN k % 6 + 1 END, CASE WHEN k % 4 <> 0 THEN k % 5 + 1 END), 2) AS n FROM a WHERE c <> 50 AND k % 3 = 0) "
    "SELECT k::VARCHAR AS e_id, concat((k % 10)::DOUBLE, '_', (k % 7)::DOUBLE) AS from_id, concat((k % 10 + 1)::DOUBLE, '_', (k % 7 + 1)::DOUBLE) AS to_id, round((s_acctbal / 100 + 100) * 1609.34, 2) AS length, road AS road_class, CASE WHEN k % 5 = 0 THEN 'Own name' ELSE coalesce(label, road) END AS road_class_detail, n::INTEGER AS lanes, (k % 2)::INTEGER AS urban, (n * 3.5)::DOUBLE AS width FROM b",
)
def converted_links(s, d):
    out = network.convert_links(_coded(s, d), "VA")
    return out.select("e_id", "from_id", "to_id", r("length", 2).alias("length"), "road_class", "road_class_detail", "lanes", "urban", "width")


@query("network_nodes", "SELECT DISTINCT concat(x::DOUBLE, '_', y::DOUBLE) AS node_id, x::DOUBLE AS x, y::DOUBLE AS y FROM (SELECT s_suppkey % 10 AS x, s_suppkey % 7 AS y FROM supplier UNION ALL SELECT s_suppkey % 10 + 1, s_suppkey % 7 + 1 FROM supplier)")
def network_nodes(s, d):
    return network.nodes_of(_coded(s, d))


@query("selected_roads", "SELECT DISTINCT from_id AS id FROM (SELECT from_id FROM net WHERE weight > 6 UNION ALL SELECT to_id FROM net WHERE weight > 6)", "net")
def selected_roads(s, d):
    net = T.nation_net(s, d).withColumnsRenamed({"e_id": "id", "from_id": "start_node", "to_id": "end_node"}).withColumn("heavy", F.when(F.col("weight") > 6, "yes").otherwise("no"))
    nodes = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("id"))
    return network.select_links(net, nodes, "heavy", ["yes"])[1]


@query("normalised_links", f"SELECT e_id, 'faf5' AS network_source, lower(trim(road_class)) AS road_class, CASE WHEN lower(trim(road_class)) IN ({MAJOR}) THEN 'major_road' ELSE 'minor_road' END AS damage_profile FROM lk", "lk")
def normalised_links(s, d):
    return network.normalise_links(T.links(s, d)).select("e_id", "network_source", "road_class", "damage_profile")


@query("speed_override", "SELECT e_id, (CASE WHEN cap < 10 THEN 0.0 WHEN cap < 60 THEN cap ELSE 60.0 END)::DOUBLE AS speed FROM (SELECT e_id, suppkey % 80 AS cap FROM lk)", "lk")
def speed_override(s, d):
    return T.links(s, d).select("e_id", cost.speed_override(F.lit(60.0), F.lit(10.0), (F.col("suppkey") % 80).cast("double")).alias("speed"))


@query("waiting_costs", "SELECT e_id, round(4.625 + least(2 + 0.15 * metres / 1000, 4.5), 6)::DOUBLE AS bus, round(3.435 + least(3 + 0.2 * metres / 1000, 250), 6)::DOUBLE AS rail FROM lk", "lk")
def waiting_costs(s, d):
    """What a trip over each link costs in waiting and fare."""
    bus, rail = cost.fares(F.col("metres") / 1000)
    return T.links(s, d).select("e_id", r(bus + cost.waiting_cost("psv"), 6).alias("bus"), r(rail + cost.waiting_cost("rail"), 6).alias("rail"))


@query("points_in_polygons", "SELECT c.id, n.id AS polygon FROM cp c JOIN np n ON c.lon >= n.lon AND c.lon < n.lon + 3 AND c.lat >= n.lat AND c.lat < n.lat + 2", "cp np")
def points_in_polygons(s, d):
    """Boxes at the nations' places, some of which overlap."""
    box = F.array(*[F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y")) for x, y in ((0, 0), (3, 0), (3, 2), (0, 2))])
    points = T.points(s, d, "customer").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.within(points, T.points(s, d, "nation").select(F.col("id").alias("polygon"), box.alias("ring")))


@query("polygon_or_nearest", "WITH i AS (SELECT c.id, min(n.id) AS polygon FROM cp c JOIN np n ON c.lon >= n.lon AND c.lon < n.lon + 3 AND c.lat >= n.lat AND c.lat < n.lat + 2 GROUP BY 1), q AS (SELECT c.id, n.id AS polygon, sqrt(pow(greatest(n.lon - c.lon, c.lon - n.lon - 3, 0), 2) + pow(greatest(n.lat - c.lat, c.lat - n.lat - 2, 0), 2)) AS m FROM cp c, np n WHERE c.id NOT IN (SELECT id FROM i)) SELECT * FROM i UNION ALL SELECT id, arg_min(polygon, (round(m, 9), polygon)) FROM q GROUP BY 1", "cp np")
def polygon_or_nearest(s, d):
    box = F.array(*[F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y")) for x, y in ((0, 0), (3, 0), (3, 2), (0, 2))])
    points = T.points(s, d, "customer").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.within_or_nearest(points, T.points(s, d, "nation").select(F.col("id").alias("polygon"), box.alias("ring")))


@query("safe_event_ids", "SELECT s_suppkey, coalesce(nullif(regexp_replace(trim(CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE concat(s_name, '-x y') END), '[^0-9A-Za-z_-]', '_', 'g'), ''), 'event_000001') AS event_id FROM supplier")
def safe_event_ids(s, d):
    name = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.concat("s_name", F.lit("-x y")))
    return s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", keys.safe_event_id(name).alias("event_id"))


@query("path_lists", "SELECT od_id, string_agg(e_id, ',' ORDER BY pos) AS path FROM st GROUP BY 1", "st")
def path_lists(s, d):
    """Paths written as text, with brackets and quotes, read again."""
    text = F.concat(F.lit("['"), F.array_join("path", "', '"), F.lit("', nan, ]"))
    return T.od_paths(s, d).select("od_id", F.array_join(inc.edge_ids(text), ",").alias("path"))


@query("strict_trucks", "SELECT od_id, round(assigned / CASE WHEN od_id % 2 = 0 THEN 20.0 ELSE 15.0 END / 365, 6) AS trucks FROM asg", "asg")
def strict_trucks(s, d):
    pay = s.createDataFrame([("even", 20.0), ("odd", 15.0)], "commodity string, payload double")
    od = _assigned(s, d).select("od_id", F.col("assigned").alias("tons"), F.when(F.col("od_id") % 2 == 0, "even").otherwise("odd").alias("commodity"))
    return demand.trucks(od, pay, fallback=None).select("od_id", r("trucks", 6).alias("trucks"))
