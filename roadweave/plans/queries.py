"""The queries over the driver's tables and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost, damage, keys
from ..operators import demand, exposure, network, report, spatial
from ..operators import incidence as inc
from ..sources import tables as T
from . import assignment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The domain of sources.tables in SQL, by name: each query takes those that it reads.
VIEWS = {
    "pe": "SELECT l_orderkey AS od_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INTEGER AS pos, concat('e', l_suppkey) AS e_id, l_suppkey FROM lineitem",
    "od": "SELECT o_orderkey AS od_id, concat('n', o_custkey) AS origin, concat('z', s_nationkey) AS destination, o_totalprice / 1000 AS flow FROM orders JOIN (SELECT od_id, max_by(l_suppkey, pos) AS last FROM pe GROUP BY 1) ON o_orderkey = od_id JOIN supplier ON s_suppkey = last",
    "st": "SELECT od_id, origin, destination, flow, pos, e_id FROM od JOIN pe USING (od_id)",
    "lk": "SELECT concat('e', s_suppkey) AS e_id, s_suppkey AS suppkey, s_nationkey AS nation, 50 * (1 + abs(s_acctbal)) AS capacity, 500.0::DOUBLE + s_suppkey % 97 * 100 AS metres, (['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'local', 'service', ' Unclassified', 'unknown'])[s_suppkey % 9 + 1] AS road_class, (1 + s_suppkey % 4)::INTEGER AS lanes, (s_suppkey % 2)::INTEGER AS urban, (s_suppkey % 5) / 10.0::DOUBLE AS toll FROM supplier",
    "tot": "SELECT e_id, sum(flow) AS total_flow, any_value(capacity) AS capacity FROM st JOIN lk USING (e_id) GROUP BY 1",
    "adj": "SELECT od_id, min(least(capacity / nullif(total_flow, 0), 1.0)) AS adjust FROM st JOIN tot USING (e_id) GROUP BY 1",
    "asg": "SELECT od.*, coalesce(adjust, 1.0) AS adjust, flow * coalesce(adjust, 1.0) AS assigned FROM od LEFT JOIN adj USING (od_id)",
    "nod": "SELECT concat('n', c_nationkey) AS origin, concat('n', s_nationkey) AS destination, CASE WHEN l_returnflag = 'R' THEN 'freight' ELSE 'passenger' END AS kind, sum(l_quantity) / 365 AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3",
    "zf": "SELECT sn.n_regionkey AS origin_zone, cn.n_regionkey AS destination_zone, p_size % 43 + 1 AS sctg, l_linenumber % 7 + 1 AS mode, year(o_orderdate)::INTEGER AS year, sum(l_quantity) AS tons, sum(l_extendedprice) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5",
    "fs": "SELECT n_regionkey AS zone, s_nationkey AS county, count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey)::DOUBLE AS factor FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "fc": "SELECT n_regionkey AS zone, c_nationkey AS county, count(*) / sum(count(*)) OVER (PARTITION BY n_regionkey)::DOUBLE AS factor FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "sg": "SELECT event_id AS segment_id, concat('e', user_id % (SELECT count(*) FROM supplier)) AS e_id, (event_id % 50)::INTEGER AS i, (event_id % 37)::INTEGER AS j, CASE WHEN event_type IN ('click', 'view') THEN 'surface' ELSE 'river' END AS hazard, value / 20 AS intensity, value * 3 AS damage, event_type AS road_label FROM events",
    "np": "SELECT n_nationkey::BIGINT AS id, (-120.0 + n_nationkey * 37 % 51)::DOUBLE AS lon, (25.0 + n_nationkey * 17 % 25)::DOUBLE AS lat, (1.0 + n_nationkey % 5)::DOUBLE AS weight FROM nation",
    "cp": "SELECT c_custkey AS id, (-120.0::DOUBLE + c_custkey * 7919 % 5003 / 100.0::DOUBLE) AS lon, (25.0::DOUBLE + c_custkey * 104729 % 2503 / 100.0::DOUBLE) AS lat FROM customer",
    "net": "SELECT concat_ws('_', 'l', f, p) AS e_id, f::VARCHAR AS from_id, t::VARCHAR AS to_id, 1.0::DOUBLE + (f * 7 + p * 3) % 11 AS weight FROM (SELECT n_nationkey AS f, unnest([0, 1, 2]) AS p, unnest([(n_nationkey + 1) % 25, (n_nationkey + 5) % 25, (3 * n_nationkey + 7) % 25]) AS t FROM nation) WHERE f <> t",
}
NEEDS = {"od": ["pe"], "st": ["pe", "od"], "tot": ["pe", "od", "st", "lk"], "adj": ["pe", "od", "st", "lk", "tot"], "asg": ["pe", "od", "st", "lk", "tot", "adj"]}


def query(name: str, body: str | None = None, views: str = ""):
    """Registers a query with the SQL of its result, after the views that it names."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if body:
            names = list(dict.fromkeys(n for v in views.split() for n in [*NEEDS.get(v, []), v]))
            head = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names)
            recursive = "RECURSIVE " if body.startswith("RECURSIVE ") else ""
            body_ = body.removeprefix("RECURSIVE ")
            more = body_.startswith("WITH ")
            SQL[name] = f"WITH {recursive}{head}{', ' + body_[5:] if more else ' ' + body_}" if head else f"WITH {recursive}{body_[5:]}" if more else body_
        return f

    return register


def r(c, digits: int = 4):
    return F.round(c, digits)


@query("assigned_flow", "SELECT od_id, origin, destination, round(flow, 6) AS flow, round(adjust, 6) AS adjust, round(assigned, 6) AS assigned FROM asg", "asg")
def assigned_flow(s, d):
    """The flagship: every path clipped by its tightest link."""
    paths = T.od_paths(s, d)
    steps = inc.incidence(paths)
    out = inc.assigned(paths, inc.od_adjustment(steps, inc.edge_totals(steps, T.links(s, d))))
    return out.select("od_id", "origin", "destination", r("flow", 6).alias("flow"), r("adjust", 6).alias("adjust"), r("assigned", 6).alias("assigned"))


@query("path_incidence", "SELECT od_id, round(flow, 6) AS flow, pos, e_id FROM st", "st")
def path_incidence(s, d):
    return inc.incidence(T.od_paths(s, d)).withColumn("flow", r("flow", 6))


@query("edge_total_flow", "SELECT e_id, round(total_flow, 6) AS total_flow, round(capacity, 6) AS capacity FROM tot", "tot")
def edge_total_flow(s, d):
    return inc.edge_totals(inc.incidence(T.od_paths(s, d)), T.links(s, d)).select("e_id", r("total_flow", 6).alias("total_flow"), r("capacity", 6).alias("capacity"))


@query("od_path_cost", "SELECT od_id, string_agg(e_id, ',' ORDER BY pos) AS path, round(sum(metres), 6) AS metres, round(sum(toll), 6) AS toll FROM st JOIN lk USING (e_id) GROUP BY 1", "st lk")
def od_path_cost(s, d):
    paths = T.od_paths(s, d)
    costs = inc.path_cost(inc.incidence(paths), T.links(s, d), ["metres", "toll"])
    return paths.select("od_id", F.array_join("path", ",").alias("path")).join(costs, "od_id").select("od_id", "path", r("metres", 6).alias("metres"), r("toll", 6).alias("toll"))


@query("od_adjustment", "SELECT od_id, round(adjust, 6) AS adjust FROM adj", "adj")
def od_adjustment(s, d):
    steps = inc.incidence(T.od_paths(s, d))
    return inc.od_adjustment(steps, inc.edge_totals(steps, T.links(s, d))).select("od_id", r("adjust", 6).alias("adjust"))


def _assigned(s, d):
    paths = T.od_paths(s, d)
    steps = inc.incidence(paths)
    return inc.assigned(paths, inc.od_adjustment(steps, inc.edge_totals(steps, T.links(s, d))))


@query("edge_flow_after_clip", "SELECT e_id, round(sum(assigned), 6) AS edge_flow FROM asg JOIN pe USING (od_id) GROUP BY 1", "asg pe")
def edge_flow_after_clip(s, d):
    return inc.edge_flow(_assigned(s, d)).select("e_id", r("edge_flow", 6).alias("edge_flow"))


@query("iteration_costs", "WITH c AS (SELECT od_id, any_value(assigned) AS f, sum(metres) AS m, sum(toll) AS t FROM asg JOIN pe USING (od_id) JOIN lk USING (e_id) GROUP BY 1) SELECT round(sum(f), 3) AS flow, round(sum(f * m), 0) AS metre_flow, round(sum(f * t), 1) AS toll FROM c", "asg pe lk")
def iteration_costs(s, d):
    a = _assigned(s, d)
    costs = inc.path_cost(inc.incidence(a.select("od_id", F.col("assigned").alias("flow"), "path")), T.links(s, d), ["metres", "toll"])
    total = inc.total_costs(a.join(costs, "od_id"))
    return total.select(r("flow", 3).alias("flow"), r("metres", 0).alias("metre_flow"), r("toll", 1).alias("toll"))


@query("remaining_demand", "WITH g AS (SELECT origin, destination, sum(flow) AS flow, sum(assigned) AS used FROM asg GROUP BY 1, 2) SELECT origin, destination, round(greatest(flow - used, 0), 6) AS flow FROM g WHERE flow - used > 1e-9", "asg")
def remaining_demand(s, d):
    a = _assigned(s, d)
    left = inc.remaining(a.groupBy("origin", "destination").agg(F.sum("flow").alias("flow")), a)
    return left.where("flow > 1e-9").withColumn("flow", r("flow", 6))


@query("isolated_od", "SELECT concat('n', o_custkey) AS origin, count(*) AS n, round(sum(o_totalprice / 1000), 6) AS flow FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def isolated_od(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet")
    lines = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(lines, "o_orderkey", "left_anti").groupBy(F.concat(F.lit("n"), "o_custkey").alias("origin")).agg(F.count("*").alias("n"), r(F.sum(F.col("o_totalprice") / 1000), 6).alias("flow"))


@query("od_surrogate_id", "WITH p AS (SELECT DISTINCT origin, destination FROM od) SELECT origin, destination, (row_number() OVER (ORDER BY origin, destination) - 1)::BIGINT AS od_id FROM p", "od")
def od_surrogate_id(s, d):
    return demand.surrogate_ids(T.od_paths(s, d).select("origin", "destination").distinct())


@query("odpfc_merge", "WITH p AS (SELECT od_id, origin, destination, any_value(flow) AS flow, string_agg(e_id, ',' ORDER BY pos) AS path FROM st GROUP BY 1, 2, 3) SELECT origin, destination, path, min(od_id) AS od_id, round(sum(flow), 6) AS flow FROM p GROUP BY 1, 2, 3", "st")
def odpfc_merge(s, d):
    return inc.merge_paths(T.od_paths(s, d)).select("origin", "destination", F.array_join("path", ",").alias("path"), "od_id", r("flow", 6).alias("flow"))


def _damaged(s, d):
    """An event a hazard: links whose mean depth does extensive damage or worse."""
    mean = T.segments(s, d).groupBy("e_id", "hazard").agg(F.avg("intensity").alias("x")).join(T.links(s, d).select("e_id", "road_class"), "e_id")
    return mean.where(damage.class_ordinal(F.col("x"), "river", F.col("road_class")) >= 3).select("e_id", F.col("hazard").alias("event"))


DMG = "WITH dm AS (SELECT e_id, hazard AS event FROM (SELECT e_id, hazard, avg(intensity) AS x FROM sg GROUP BY 1, 2) JOIN lk USING (e_id) WHERE x >= 2 AND lower(trim(road_class)) <> 'unknown')"


@query("event_candidates", f"{DMG} SELECT event, od_id, string_agg(e_id, ',' ORDER BY pos) AS hits, round(any_value(flow), 6) AS flow FROM st JOIN dm USING (e_id) GROUP BY 1, 2", "st lk sg")
def event_candidates(s, d):
    return inc.event_candidates(T.od_paths(s, d), _damaged(s, d)).select("event", "od_id", F.array_join("hits", ",").alias("hits"), r("flow", 6).alias("flow"))


@query("disrupted_flow", f"{DMG} SELECT event, od_id, round(greatest(any_value(flow) - min(capacity) / 1000, 0), 6) AS disrupted FROM st JOIN dm USING (e_id) JOIN lk USING (e_id) GROUP BY 1, 2 HAVING any_value(flow) - min(capacity) / 1000 > 0", "st lk sg")
def disrupted_flow(s, d):
    cap = T.links(s, d).select("e_id", (F.col("capacity") / 1000).alias("capacity"))
    return inc.disrupted(inc.event_candidates(T.od_paths(s, d), _damaged(s, d)), cap).withColumn("disrupted", r("disrupted", 6))


@query("od_normalise", "SELECT origin, destination, round(sum(flow), 4) AS flow FROM nod GROUP BY 1, 2 HAVING sum(flow) > 0", "nod")
def od_normalise(s, d):
    return demand.normalise(T.nation_od(s, d)).withColumn("flow", r("flow"))


@query("od_freight_passenger_outer", "WITH f AS (SELECT * FROM nod WHERE kind = 'freight'), p AS (SELECT * FROM nod WHERE kind = 'passenger') SELECT coalesce(f.origin, p.origin) AS origin, coalesce(f.destination, p.destination) AS destination, round(coalesce(f.flow, 0), 4) AS freight, round(coalesce(p.flow, 0), 4) AS passenger, round(coalesce(f.flow, 0) + coalesce(p.flow, 0), 4) AS flow FROM f FULL JOIN p ON f.origin = p.origin AND f.destination = p.destination", "nod")
def od_freight_passenger_outer(s, d):
    od = T.nation_od(s, d)
    out = demand.combine(od.where("kind = 'freight'"), od.where("kind = 'passenger'"))
    return out.select("origin", "destination", r("freight").alias("freight"), r("passenger").alias("passenger"), r("flow").alias("flow"))


@query("od_restrict_pairs", "SELECT origin, destination, kind, round(flow, 4) AS flow FROM nod WHERE origin < destination", "nod")
def od_restrict_pairs(s, d):
    od = T.nation_od(s, d)
    return demand.restrict(od, od.where("origin < destination").distinct()).select("origin", "destination", "kind", r("flow").alias("flow"))


@query("od_overlay_first_candidate", "SELECT origin, destination, min(od_id) AS od_id, round(sum(flow), 6) AS flow FROM od GROUP BY 1, 2", "od")
def od_overlay_first_candidate(s, d):
    p = T.od_paths(s, d)
    return demand.first_candidate(p.select("od_id", "origin", "destination", "flow"), p).select("origin", "destination", "od_id", r("flow", 6).alias("flow"))


@query("factor_sum_check", "SELECT zone, round(sum(factor), 6) AS total, abs(sum(factor) - 1) <= 1e-6 AS ok FROM fs GROUP BY 1", "fs")
def factor_sum_check(s, d):
    return demand.factor_sums(T.nation_factors(s, d, "supplier"), ["zone"]).withColumn("total", r("total", 6))


@query("county_disaggregation", "SELECT o.county AS origin, d.county AS destination, year, round(sum(tons * o.factor * d.factor), 3) AS tons, round(sum(value * o.factor * d.factor), 1) AS value FROM (SELECT origin_zone, destination_zone, year, sum(tons) AS tons, sum(value) AS value FROM zf WHERE mode = 1 GROUP BY 1, 2, 3) z JOIN fs o ON o.zone = origin_zone JOIN fc d ON d.zone = destination_zone GROUP BY 1, 2, 3", "zf fs fc")
def county_disaggregation(s, d):
    flows = T.zone_flows(s, d).where(keys.mode_is(F.col("mode"), "Truck")).groupBy("origin_zone", "destination_zone", "year").agg(F.sum("tons").alias("tons"), F.sum("value").alias("value"))
    out = demand.disaggregate(flows, T.nation_factors(s, d, "supplier"), T.nation_factors(s, d, "customer"), ["tons", "value"])
    return out.withColumns({"tons": r("tons", 3), "value": r("value", 1)})


@query("county_by_group", "SELECT CASE WHEN sctg <= 9 THEN 'sctg0109' WHEN sctg <= 14 THEN 'sctg1014' WHEN sctg <= 19 THEN 'sctg1519' WHEN sctg <= 33 THEN 'sctg2033' ELSE 'sctg3499' END AS commodity_group, year, round(sum(tons), 3) AS tons FROM zf GROUP BY 1, 2", "zf")
def county_by_group(s, d):
    return T.zone_flows(s, d).groupBy(keys.commodity_group(F.col("sctg")).alias("commodity_group"), "year").agg(r(F.sum("tons"), 3).alias("tons"))


@query("missing_factors", "SELECT origin_zone, count(*) AS n, round(sum(tons), 3) AS tons FROM zf WHERE origin_zone NOT IN (SELECT zone FROM fs WHERE zone < 3) GROUP BY 1", "zf fs")
def missing_factors(s, d):
    return demand.missing_factors(T.zone_flows(s, d), T.nation_factors(s, d, "supplier").where("zone < 3")).withColumn("tons", r("tons", 3))


@query("weight_shares", "SELECT nation, e_id, round(CASE WHEN sum(toll) OVER w > 0 THEN toll / sum(toll) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS share FROM lk WINDOW w AS (PARTITION BY nation)", "lk")
def weight_shares(s, d):
    return demand.shares(T.links(s, d), ["nation"], "toll").select("nation", "e_id", r("share", 6).alias("share"))


@query("gravity_od", "WITH w AS (SELECT n_regionkey AS zone, n_nationkey AS subarea, 1.0 + n_nationkey % 3 AS production, 1.0 + n_nationkey % 4 AS attraction FROM nation), f AS (SELECT origin_zone, destination_zone, sum(tons) AS tons FROM zf GROUP BY 1, 2), x AS (SELECT f.*, o.subarea AS origin, d.subarea AS destination, o.production * d.attraction / greatest(abs(o.subarea - d.subarea) * 10.0, 1.0) AS w FROM f JOIN w o ON o.zone = origin_zone JOIN w d ON d.zone = destination_zone), y AS (SELECT *, w / sum(w) OVER (PARTITION BY origin_zone, destination_zone) AS share FROM x) SELECT origin, destination, round(sum(tons * share), 3) AS tons FROM y GROUP BY 1, 2", "zf")
def gravity_od(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    w = n.select(F.col("n_regionkey").alias("zone"), F.col("n_nationkey").alias("subarea"), (1.0 + F.col("n_nationkey") % 3).alias("production"), (1.0 + F.col("n_nationkey") % 4).alias("attraction"))
    a, b = n.select(F.col("n_nationkey").alias("a")), n.select(F.col("n_nationkey").alias("b"))
    dist = a.join(b, F.col("a") != F.col("b")).withColumn("miles", F.abs(F.col("a") - F.col("b")) * 10.0)
    flows = T.zone_flows(s, d).groupBy("origin_zone", "destination_zone").agg(F.sum("tons").alias("tons"))
    return demand.gravity(flows, w, dist).withColumn("tons", r("tons", 3))


@query("payload_trucks", "SELECT sctg AS commodity, round(sum(tons) / coalesce(CASE sctg WHEN 1 THEN 20.0 WHEN 2 THEN 18.0 END, 15.0) / 365, 5) AS trucks FROM zf GROUP BY 1", "zf")
def payload_trucks(s, d):
    payload = s.createDataFrame([("1", 20.0), ("2", 18.0), ("all", 15.0)], "commodity string, payload double")
    od = T.zone_flows(s, d).groupBy(F.col("sctg").cast("string").alias("commodity")).agg(F.sum("tons").alias("tons"))
    return demand.trucks(od, payload).select(F.col("commodity").cast("int").alias("commodity"), r("trucks", 5).alias("trucks"))


@query("nearest_centroid", "WITH m AS (SELECT cp.id, np.id AS near_id, 2 * 3958.7613 * asin(sqrt(least(1.0, power(sin(radians(np.lat - cp.lat) / 2), 2) + cos(radians(cp.lat)) * cos(radians(np.lat)) * power(sin(radians(np.lon - cp.lon) / 2), 2)))) AS miles FROM cp, np) SELECT id, arg_min(near_id, struct_pack(m := miles, i := near_id)) AS near_id, round(min(miles), 4) AS miles FROM m GROUP BY 1", "cp np")
def nearest_centroid(s, d):
    return demand.nearest(T.points(s, d, "customer"), T.points(s, d, "nation"), 8.0).withColumn("miles", r("miles"))


@query("inverse_distance_od", "WITH x AS (SELECT a.id AS origin, b.id AS destination, a.weight * b.weight / power(greatest(2 * 3958.7613 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))), 1.0), 2) AS w FROM np a JOIN np b ON a.id <> b.id) SELECT origin, destination, round(1000.0 * w / sum(w) OVER (), 5) AS flow FROM x", "np")
def inverse_distance_od(s, d):
    return demand.inverse_distance_od(T.points(s, d, "nation"), 1000.0).withColumn("flow", r("flow", 5))


TIER = "CASE lower(trim(road_class)) WHEN 'motorway' THEN 'freeway' WHEN 'trunk' THEN 'freeway' WHEN 'tertiary' THEN 'collector' WHEN 'service' THEN 'local_access' WHEN 'unclassified' THEN 'local_access' ELSE 'arterial' END"


def _tier(values):
    return f"CASE {TIER} WHEN 'freeway' THEN {values[0]} WHEN 'collector' THEN {values[2]} WHEN 'local_access' THEN {values[3]} ELSE {values[1]} END"


SPEED = f"CASE WHEN urban > 0 THEN least({_tier((70, 60, 55, 35))}, {_tier((55, 45, 35, 30))}) ELSE {_tier((70, 60, 55, 35))} END::DOUBLE"


@query("link_tiers", f"SELECT e_id, {TIER} AS tier, ({_tier((2400, 2200, 1700, 1000))} * lanes * 24)::DOUBLE AS acc_capacity, {SPEED} AS initial_speed FROM lk", "lk")
def link_tiers(s, d):
    return network.edge_init(T.links(s, d)).select("e_id", "tier", "acc_capacity", "initial_speed")


def _cost_sql(v):
    a, b, c, e = cost.FUEL_CURVE[v]
    a1, b1 = cost.OTHER_CURVE[v]
    return f"WITH x AS (SELECT e_id, toll, metres * 0.000621371 AS mi, metres * 0.000621371 / {SPEED} AS t FROM lk), y AS (SELECT *, mi * 1.60934 AS km, mi * 1.60934 / greatest(t, 1e-6) AS v FROM x) SELECT e_id, round(t * {cost.VALUE_OF_TIME[v]}{' * 1.06' if v == 'car' else ''} + (({a} / greatest(v, 1e-6) + {b} + {c} * v + {e:.12f} * v * v) * {cost.FUEL_PRICE[v]} + ({a1} + {b1} / greatest(v, 1e-6)) / 100) * km + toll, 6) AS weight FROM y"


for _v in ("car", "lgv", "ogv"):

    @query(f"link_cost_{_v}", _cost_sql(_v), "lk")
    def link_cost(s, d, v=_v):
        l = network.edge_init(T.links(s, d))
        return l.select("e_id", r(cost.link_cost(F.col("metres"), F.col("initial_speed"), F.col("toll"), v), 6).alias("weight"))


@query("congestion_speed", f"SELECT e_id, round(greatest({SPEED} - {_tier((0.033, 0.033, 0.05, 0.05))} * greatest(total_flow / 24 - {_tier((1400, 1300, 1100, 800))}, 0), {_tier((10, 8, 7, 5))}), 4) AS acc_speed FROM lk JOIN (SELECT e_id, total_flow FROM tot) USING (e_id)", "tot lk")
def congestion_speed(s, d):
    l = network.edge_init(T.links(s, d)).join(inc.edge_totals(inc.incidence(T.od_paths(s, d)), T.links(s, d)).select("e_id", "total_flow"), "e_id")
    v = cost.congestion_speed(F.col("total_flow"), F.col("initial_speed"), cost.tier_value(F.col("tier"), 5), F.col("breakpoint"), F.col("min_speed"))
    return l.select("e_id", r(v).alias("acc_speed"))


@query("fares", "SELECT e_id, round(least(2 + 0.15 * metres / 1000, 4.5), 6) AS bus, round(least(3 + 0.2 * metres / 1000, 250), 6) AS rail FROM lk", "lk")
def fares(s, d):
    bus, rail = cost.fares(F.col("metres") / 1000)
    return T.links(s, d).select("e_id", r(bus, 6).alias("bus"), r(rail, 6).alias("rail"))


@query("bpr_time", "SELECT e_id, round(CASE WHEN capacity <= 0 OR total_flow <= 0 THEN 10.0 ELSE 10.0 * (1 + 0.15 * power(total_flow / capacity, 4)) END, 4) AS minutes FROM tot", "tot")
def bpr_time(s, d):
    t = inc.edge_totals(inc.incidence(T.od_paths(s, d)), T.links(s, d))
    return t.select("e_id", r(cost.bpr_time(F.lit(10.0), F.col("total_flow"), F.col("capacity"))).alias("minutes"))


@query("segment_dedupe", "SELECT e_id, i, j, round(max(intensity), 6) AS intensity, round(max(damage), 4) AS damage FROM sg GROUP BY 1, 2, 3", "sg")
def segment_dedupe(s, d):
    out = exposure.dedupe_segments(T.segments(s, d).select("e_id", "i", "j", "intensity", "damage"), ["e_id", "i", "j"])
    return out.select("e_id", "i", "j", r("intensity", 6).alias("intensity"), r("damage").alias("damage"))


def _level_sql(hazard, value):
    def one(t):
        steps = [(lim, i) for i, lim in enumerate(t, 1) if lim is not None]
        return "CASE " + " ".join(f"WHEN {value} {'>' if lim == 0 else '>='} {lim} THEN '{damage.LEVELS[i]}'" for lim, i in reversed(steps)) + " ELSE 'no' END"

    major, other = damage.THRESHOLDS[hazard]
    classes = ", ".join(f"'{c}'" for c in (*cost.MAJOR_CLASSES, *(("tertiary",) if hazard in damage.WIDER_MAJOR else ())))
    known = ", ".join(f"'{c}'" for c in damage.DAMAGEABLE)
    unknown = f"WHEN lower(trim(road_class)) NOT IN ({known}) THEN 'no' " if hazard in damage.FLOODS else ""
    return f"CASE {unknown}WHEN lower(trim(road_class)) IN ({classes}) THEN {one(major)} ELSE {one(other)} END"


def _levels(hazard, scale):
    x = "(intensity * 100.0)" if hazard in damage.FLOODS else f"(intensity * {scale})"

    @query(f"{hazard}_levels", f"SELECT segment_id, {_level_sql(hazard, x)} AS level FROM sg JOIN lk USING (e_id)", "sg lk")
    def levels(s, d):
        seg = T.segments(s, d).withColumn("x", F.col("intensity") if hazard in damage.FLOODS else F.col("intensity") * scale).join(T.links(s, d).select("e_id", "road_class"), "e_id")
        return exposure.segment_levels(seg, hazard, "x").select("segment_id", F.col("level_name").alias("level"))


for _h, _s in (("surface", 1.0), ("river", 1.0), ("coastal", 1.0), ("snow", 100.0), ("earthquake", 0.1), ("landslide", 50.0), ("winter_storm", 40.0)):
    _levels(_h, _s)


@query("link_exposure", "WITH m AS (SELECT e_id, max(intensity) AS intensity FROM sg GROUP BY 1) SELECT e_id, round(coalesce(intensity, 0), 6) AS intensity FROM lk LEFT JOIN m USING (e_id)", "lk sg")
def link_exposure(s, d):
    seg = T.segments(s, d).withColumn("level", F.lit(0))
    return exposure.link_exposure(T.links(s, d), seg).select("e_id", r("intensity", 6).alias("intensity"))


@query("speed_cap_quadratic", "SELECT segment_id, round(CASE WHEN intensity < 3 THEN 60 * power(intensity / 3 - 1, 2) ELSE 0 END, 6) AS max_speed FROM sg", "sg")
def speed_cap_quadratic(s, d):
    return T.segments(s, d).select("segment_id", r(damage.speed_cap_quadratic(F.lit(60.0), F.col("intensity"), F.lit(3.0)), 6).alias("max_speed"))


@query("speed_cap_step", f"SELECT segment_id, 60 * CASE {_level_sql('river', '(intensity * 100.0)')} WHEN 'minor' THEN 0.85 WHEN 'moderate' THEN 0.5 WHEN 'no' THEN 1.0 ELSE 0.0 END::DOUBLE AS max_speed FROM sg JOIN lk USING (e_id)", "sg lk")
def speed_cap_step(s, d):
    seg = exposure.segment_levels(T.segments(s, d).join(T.links(s, d).select("e_id", "road_class"), "e_id"), "river")
    return seg.select("segment_id", damage.speed_cap_step(F.lit(60.0), F.col("level_name")).alias("max_speed"))


CURVE = [(0.0, 0.0), (1.0, 0.1), (3.0, 0.4), (6.0, 1.0)]


@query("damage_fraction", "SELECT segment_id, round(CASE WHEN intensity <= 0 THEN 0 WHEN intensity <= 1 THEN intensity * 0.1 WHEN intensity <= 3 THEN 0.1 + (intensity - 1) * 0.15 WHEN intensity <= 6 THEN 0.4 + (intensity - 3) * 0.2 ELSE 1.0 END, 6) AS fraction FROM sg", "sg")
def damage_fraction(s, d):
    return T.segments(s, d).select("segment_id", r(damage.fraction(F.col("intensity"), CURVE), 6).alias("fraction"))


@query("damage_cost", "SELECT e_id, round(sum(metres * 1e-3 * lanes * 2.5 * CASE WHEN intensity <= 0 THEN 0 WHEN intensity <= 1 THEN intensity * 0.1 WHEN intensity <= 3 THEN 0.1 + (intensity - 1) * 0.15 WHEN intensity <= 6 THEN 0.4 + (intensity - 3) * 0.2 ELSE 1.0 END), 4) AS cost FROM sg JOIN lk USING (e_id) GROUP BY 1", "sg lk")
def damage_cost(s, d):
    seg = T.segments(s, d).join(T.links(s, d), "e_id")
    return seg.groupBy("e_id").agg(r(F.sum(damage.road_cost(F.col("metres"), F.col("lanes"), F.lit(2.5), damage.fraction(F.col("intensity"), CURVE)))).alias("cost"))


@query("edge_damage", "SELECT e_id, round(sum(damage), 3) AS damage, arg_min(road_label, segment_id) AS road_label FROM sg GROUP BY 1", "sg")
def edge_damage(s, d):
    return exposure.edge_damage(T.segments(s, d).withColumn("level", F.lit(0))).select("e_id", r("damage", 3).alias("damage"), "road_label")


@query("event_damage_summary", "SELECT hazard, count(*) AS n, count(DISTINCT e_id) AS links, round(sum(damage), 2) AS damage FROM sg GROUP BY 1", "sg")
def event_damage_summary(s, d):
    return T.segments(s, d).groupBy("hazard").agg(F.count("*").alias("n"), F.countDistinct("e_id").alias("links"), r(F.sum("damage"), 2).alias("damage"))


@query("recovery_capacity", "WITH x AS (SELECT e_id, capacity, CASE WHEN suppkey % 4 = 0 THEN 'bridge' ELSE 'road' END AS asset, (['no', 'minor', 'moderate', 'extensive', 'severe'])[suppkey % 5 + 1] AS level FROM lk), t(asset, level, rate) AS (VALUES ('bridge', 'minor', 0.5), ('bridge', 'moderate', 0.4), ('bridge', 'extensive', 0.3), ('bridge', 'severe', 0.2), ('road', 'minor', 0.6), ('road', 'moderate', 0.5), ('road', 'extensive', 0.4), ('road', 'severe', 0.3)) SELECT e_id, asset, level, round(CASE WHEN level = 'no' THEN capacity ELSE capacity * coalesce(rate, 0) END, 4) AS capacity_now FROM x LEFT JOIN t USING (asset, level)", "lk")
def recovery_capacity(s, d):
    rates = s.createDataFrame([(a, lv, 1, v) for a, vs in (("bridge", (0.5, 0.4, 0.3, 0.2)), ("road", (0.6, 0.5, 0.4, 0.3))) for lv, v in zip(damage.LEVELS[1:], vs)], "asset string, level string, day int, rate double")
    l = T.links(s, d).select("e_id", "capacity", F.when(F.col("suppkey") % 4 == 0, "bridge").otherwise("road").alias("asset"), damage.level_name(F.col("suppkey") % 5).alias("level"))
    return exposure.recovery_capacity(l, rates, 1).select("e_id", "asset", "level", r("capacity_now").alias("capacity_now"))


@query("day_speed_gate", "SELECT segment_id, day, CASE WHEN day = 1 OR (day = 2 AND intensity >= 2 AND intensity < 6) OR (day = 3 AND intensity >= 6) THEN least(60.0, 20.0) ELSE 60.0 END::DOUBLE AS speed FROM sg, (VALUES (1), (2), (3)) t(day)", "sg")
def day_speed_gate(s, d):
    seg = T.segments(s, d)
    parts = [seg.select("segment_id", F.lit(day).alias("day"), exposure.day_gate(day, F.lit(60.0), F.lit(20.0), F.col("intensity")).alias("speed")) for day in (1, 2, 3)]
    return parts[0].union(parts[1]).union(parts[2])


@query("flow_distribution", "SELECT count(flow) AS n, round(sum(flow), 6) AS total, round(max(flow), 6) AS largest, round(median(flow), 6) AS median, round(quantile_cont(flow, 0.99), 6) AS p99 FROM od", "od")
def flow_distribution(s, d):
    out = report.flow_distribution(T.od_paths(s, d))
    return out.select("n", r("total", 6).alias("total"), r("largest", 6).alias("largest"), r("median", 6).alias("median"), r("p99", 6).alias("p99"))


@query("commodity_share", "SELECT sctg, round(sum(tons), 3) AS tons, round(sum(tons) * 100 / sum(sum(tons)) OVER (), 6) AS share FROM zf GROUP BY 1", "zf")
def commodity_share(s, d):
    return report.share_of_total(T.zone_flows(s, d), "sctg", "tons").select("sctg", r("tons", 3).alias("tons"), r("share", 6).alias("share"))


@query("undirected_pair_flow", "SELECT least(origin, destination) AS a, greatest(origin, destination) AS b, round(sum(flow), 4) AS flow FROM nod GROUP BY 1, 2", "nod")
def undirected_pair_flow(s, d):
    return report.undirected(T.nation_od(s, d), "origin", "destination", "flow").withColumn("flow", r("flow"))


@query("flow_correlation", "WITH x AS (SELECT total_flow AS x, capacity AS y FROM tot) SELECT round(corr(x, y), 6) AS correlation, round(avg(abs(x - y)), 2) AS mae, round(avg(abs(x - y) / greatest(x, 1)), 6) AS mape FROM x", "tot")
def flow_correlation(s, d):
    t = inc.edge_totals(inc.incidence(T.od_paths(s, d)), T.links(s, d))
    return report.comparison(t, "total_flow", "capacity").select(r("correlation", 6).alias("correlation"), r("mae", 2).alias("mae"), r("mape", 6).alias("mape"))


@query("top_links", "SELECT e_id, round(total_flow, 6) AS total_flow FROM tot ORDER BY tot.total_flow DESC, e_id LIMIT 10", "tot")
def top_links(s, d):
    t = inc.edge_totals(inc.incidence(T.od_paths(s, d)), T.links(s, d)).select("e_id", "total_flow")
    return report.top(t, "total_flow", "e_id", 10).withColumn("total_flow", r("total_flow", 6))


def _all_pairs(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("n"))
    return n.select(F.col("n").alias("origin")).join(n.select(F.col("n").alias("destination")), F.col("origin") != F.col("destination"))


@query("least_cost", "RECURSIVE WITH e AS (SELECT from_id AS a, to_id AS b, min(weight) AS w FROM (SELECT from_id, to_id, weight FROM net UNION ALL SELECT to_id, from_id, weight FROM net) GROUP BY 1, 2), g AS (SELECT a AS origin, b AS destination, w AS cost, 1 AS n FROM e UNION SELECT g.origin, e.b, g.cost + e.w, g.n + 1 FROM g JOIN e ON g.destination = e.a WHERE g.n < 6 AND e.b <> g.origin) SELECT origin, destination, round(min(cost), 4) AS cost FROM g WHERE origin <> destination GROUP BY 1, 2", "net")
def least_cost(s, d):
    return network.least_cost_paths(_all_pairs(s, d), T.nation_net(s, d)).select("origin", "destination", r("cost").alias("cost"))


@query("components", "SELECT node, min(node) OVER (PARTITION BY node::INTEGER % 7) AS component FROM (SELECT DISTINCT s_suppkey::VARCHAR AS node FROM supplier)")
def components(s, d):
    k = F.col("s_suppkey")
    edges = s.read.parquet(f"{d}/supplier.parquet").select(k.cast("string").alias("a"), F.when(k >= 7, k - 7).otherwise(k).cast("string").alias("b"))
    return network.components(edges)


@query("capacity_loop")
def capacity_loop(s, d):
    od = T.nation_od(s, d).groupBy(F.substring("origin", 2, 9).alias("origin"), F.substring("destination", 2, 9).alias("destination")).agg(F.sum("flow").alias("flow")).where("origin <> destination")
    net = T.nation_net(s, d).withColumn("capacity", F.lit(40.0))
    out = assignment.capacity_loop(od, net, max_iterations=10_000)
    flows = out.links.select("e_id", r("acc_flow").alias("acc_flow"), r("acc_capacity").alias("acc_capacity"))
    return flows.union(out.isolated.agg(F.lit("isolated").alias("e_id"), r(F.coalesce(F.sum("flow"), F.lit(0.0))).alias("acc_flow"), F.lit(None).cast("double").alias("acc_capacity")))


@query("line_grid")
def line_grid(s, d):
    p = T.points(s, d, "customer")
    lines = p.select(F.concat(F.lit("c"), "id").alias("e_id"), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct((F.col("lon") + F.col("weight")).alias("x"), (F.col("lat") - 1).alias("y"))).alias("vertices"))
    cells = s.range(0, 120 * 60).select((F.col("id") % 120).cast("int").alias("col"), F.floor(F.col("id") / 120).cast("int").alias("row")).withColumn("value", F.col("col") * 0.1 + F.col("row"))
    return spatial.intersect_grid(lines, cells, -125.0, 20.0, 1.0, 1.0).withColumn("length", r("length", 6))


@query("path_index", "WITH p AS (SELECT od_id, any_value(flow) AS flow, string_agg(e_id, ',' ORDER BY pos) AS path FROM st GROUP BY 1) SELECT path, count(*) AS n, round(sum(flow), 6) AS flow FROM p GROUP BY 1", "st")
def path_index(s, d):
    return inc.path_index(T.od_paths(s, d)).select(F.array_join("path", ",").alias("path"), "n", r("flow", 6).alias("flow"))


@query("path_index_candidates", f"{DMG}, p AS (SELECT od_id, any_value(flow) AS flow, string_agg(e_id, ',' ORDER BY pos) AS path FROM st GROUP BY 1), m AS (SELECT path, count(*) AS n, sum(flow) AS flow, any_value(od_id) AS od_id FROM p GROUP BY 1), u AS (SELECT path, event, e_id, min(pos) AS pos FROM m JOIN pe USING (od_id) JOIN dm USING (e_id) GROUP BY 1, 2, 3) SELECT event, path, string_agg(e_id, ',' ORDER BY u.pos) AS hits, any_value(n) AS n, round(any_value(flow), 6) AS flow FROM u JOIN m USING (path) GROUP BY 1, 2", "st lk sg")
def path_index_candidates(s, d):
    index = inc.path_index(T.od_paths(s, d))
    return inc.index_candidates(index, _damaged(s, d)).select("event", F.array_join("path", ",").alias("path"), F.array_join("hits", ",").alias("hits"), "n", r("flow", 6).alias("flow"))


@query("disrupted_edge_flow", f"{DMG}, c AS (SELECT event, od_id, greatest(any_value(flow) - min(capacity) / 1000, 0) AS f FROM st JOIN dm USING (e_id) JOIN lk USING (e_id) GROUP BY 1, 2) SELECT event, e_id, round(sum(f), 1) AS edge_flow FROM c JOIN pe USING (od_id) WHERE f > 0 GROUP BY 1, 2", "st lk sg")
def disrupted_edge_flow(s, d):
    paths = T.od_paths(s, d)
    cap = T.links(s, d).select("e_id", (F.col("capacity") / 1000).alias("capacity"))
    lost = inc.disrupted_paths(paths, _damaged(s, d), cap, ["path"])
    return lost.select("event", "disrupted", F.explode("path").alias("e_id")).groupBy("event", "e_id").agg(r(F.sum("disrupted"), 1).alias("edge_flow"))


@query("commuter_county", "SELECT sn.n_regionkey AS origin, cn.n_regionkey AS destination, count(*)::BIGINT AS jobs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2")
def commuter_county(s, d):
    lookup = s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("block"), F.col("n_regionkey").alias("county"))
    line = s.read.parquet(f"{d}/lineitem.parquet").join(s.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(s.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).join(s.read.parquet(f"{d}/supplier.parquet"), F.col("l_suppkey") == F.col("s_suppkey"))
    blocks = line.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("home"), F.concat(F.lit("n"), "c_nationkey").alias("work")).agg(F.count("*").alias("jobs"))
    return demand.commuter_od(blocks, lookup)


@query("centroid_od", "SELECT concat('c', substr(origin, 2)::INTEGER % 7) AS origin, concat('c', substr(destination, 2)::INTEGER % 7) AS destination, round(sum(flow), 4) AS flow FROM nod WHERE substr(origin, 2)::INTEGER < 20 AND substr(destination, 2)::INTEGER < 20 GROUP BY 1, 2", "nod")
def centroid_od(s, d):
    k = F.col("n_nationkey")
    mapping = s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n"), k).alias("zone"), F.when(k < 20, F.concat(F.lit("c"), k % 7)).alias("node"))
    return demand.to_nodes(T.nation_od(s, d), mapping, ["flow"]).withColumn("flow", r("flow"))


@query("tonnage_preservation", "SELECT year, round(sum(tons), 3) AS before, round(sum(tons), 3) AS after, true AS ok FROM zf GROUP BY 1", "zf")
def tonnage_preservation(s, d):
    flows = T.zone_flows(s, d)
    after = demand.disaggregate(flows.select("origin_zone", "destination_zone", "year", "tons"), T.nation_factors(s, d, "supplier"), T.nation_factors(s, d, "customer"), ["tons"])
    return demand.preserved(flows, after, "year", "tons").withColumns({"before": r("before", 3), "after": r("after", 3)})


@query("balance_totals", "SELECT origin, destination, kind, round(flow * 1000 / sum(flow) OVER (PARTITION BY kind), 5) AS flow FROM nod", "nod")
def balance_totals(s, d):
    targets = s.createDataFrame([("freight", 1000.0), ("passenger", 1000.0)], "kind string, target double")
    return demand.balance(T.nation_od(s, d), ["kind"], "flow", targets).select("origin", "destination", "kind", r("flow", 5).alias("flow"))


@query("damage_consolidated", "SELECT segment_id, round((CASE segment_id % 4 WHEN 0 THEN (damage + intensity) / 2 WHEN 1 THEN damage WHEN 2 THEN 2 * intensity ELSE 0.0 END + CASE WHEN segment_id % 2 = 0 THEN 3 * intensity ELSE 0.0 END) * 1e6, 0) AS usd FROM sg", "sg")
def damage_consolidated(s, d):
    """Pairs with both curves, with one of them, with none, and a second type of flood on every other segment."""
    x, i, none = F.col("segment_id"), F.col("intensity"), F.lit(None).cast("double")
    of = lambda k, c, m=4: F.when(x % m == k, c)
    first = [(F.coalesce(of(0, F.col("damage")), of(1, F.col("damage"))), of(0, i)), (none, of(2, 2 * i))]
    both = damage.consolidated([first, [(none, none), (of(0, 3 * i, 2), none)]])
    return T.segments(s, d).select("segment_id", r(both * 1e6, 0).alias("usd"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import geo_queries, network_queries, stage_queries  # noqa: E402, F401
