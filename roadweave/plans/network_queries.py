"""Queries of searches and iterated assignment, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cost
from ..operators import incidence as inc
from ..operators import network, path_index, paths
from ..operators.spatial import line_length
from ..session import shared_folder
from ..sources import tables as T
from . import assignment
from .queries import SPEED, SQL, _damaged, query, r

#: Places in a row of the customers' grid.
ROW = 40


@query(
    "cell_paths",
    "WITH RECURSIVE c AS (SELECT c_custkey::BIGINT AS k, c_nationkey AS n, 1 + abs(c_acctbal) AS w FROM customer), "
    f"g AS (SELECT a.k AS a, b.k AS b, a.w FROM c a JOIN c b ON b.k = a.k + {ROW} OR (b.k = a.k + 1 AND b.k % {ROW} <> 0)), "
    "e AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g), p AS (SELECT min(k) AS o, max(k) AS d FROM c GROUP BY n HAVING min(k) < max(k)), "
    "t(o, k, cost) USING KEY (o, k) AS (SELECT o, o, 0.0::DOUBLE FROM p UNION (SELECT t.o, e.b, min(t.cost + e.w) FROM t JOIN e ON t.k = e.a LEFT JOIN recurring.t x ON x.o = t.o AND x.k = e.b WHERE x.cost IS NULL OR t.cost + e.w < x.cost GROUP BY 1, 2)) "
    "SELECT p.o AS origin, p.d AS destination, round(cost, 4) AS cost FROM p JOIN t ON t.o = p.o AND t.k = p.d",
)
def cell_paths(s, d):
    """Customers as places of a grid, cell by cell: from each nation's first to its last."""
    k = F.col("c_custkey").cast("long")
    c = s.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), F.col("c_nationkey").alias("n"), (1 + F.abs("c_acctbal")).alias("w"))
    name = lambda col: F.lpad(col.cast("string"), 12, "0")
    ends = F.explode(F.array(F.struct(F.lit("v").alias("kind"), (F.col("k") + ROW).alias("to")), F.struct(F.lit("h").alias("kind"), (F.col("k") + 1).alias("to")))).alias("e")
    links = c.select("k", "w", ends).where(f"e.kind = 'v' OR e.to % {ROW} <> 0").join(c.select(F.col("k").alias("there")), F.col("e.to") == F.col("there"))
    links = links.select(F.concat("e.kind", name(F.col("k"))).alias("e_id"), name(F.col("k")).alias("from_id"), name(F.col("e.to")).alias("to_id"), F.col("w").alias("weight"))
    od = c.groupBy("n").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select(name(F.col("a")).alias("origin"), name(F.col("b")).alias("destination"))
    out = paths.cell_paths(od, links, paths.cells_by_place(c.select(name(F.col("k")).alias("node"), (F.col("k") % ROW).cast("double").alias("x"), F.floor(F.col("k") / ROW).cast("double").alias("y")), 2000))
    return out.where("cost IS NOT NULL").select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination"), r("cost").alias("cost"))


def _parts(vehicle: str) -> str:
    a, b, c, e = cost.FUEL_CURVE.get(vehicle, (0, 0, 0, 0))
    a1, b1 = cost.OTHER_CURVE.get(vehicle, (0, 0))
    fuel = "0.0" if vehicle in ("psv", "rail") else f"(({a} / greatest(v, 1e-6) + {b} + {c} * v + {e:.12f} * v * v) * {cost.FUEL_PRICE[vehicle]} + ({a1} + {b1} / greatest(v, 1e-6)) / 100) * km"
    fare = {"psv": "least(2 + 0.15 * m / 1000, 4.5)", "rail": "least(3 + 0.2 * m / 1000, 250)"}.get(vehicle, "0.0")
    return (
        f"SELECT '{vehicle}' AS vehicle, round(sum(assigned * (time + {cost.waiting_cost(vehicle)})), 0) AS time, round(sum(assigned * fuel), 0) AS fuel, round(sum(assigned * toll), 0) AS toll, round(sum(assigned * {fare}), 0) AS fare "
        f"FROM (SELECT od_id, any_value(assigned) AS assigned, sum(t * {cost.VALUE_OF_TIME[vehicle]}{' * 1.06' if vehicle == 'car' else ''}) AS time, sum({fuel}) AS fuel, sum(toll) AS toll, sum(metres) AS m FROM x GROUP BY 1)"
    )


@query("assignment_costs", f"WITH x AS (SELECT od_id, assigned, toll, metres, t, mi * 1.60934 AS km, mi * 1.60934 / greatest(t, 1e-6) AS v FROM (SELECT od_id, assigned, toll, metres, metres * 0.000621371 AS mi, metres * 0.000621371 / {SPEED} AS t FROM asg JOIN pe USING (od_id) JOIN lk USING (e_id))) " + " UNION ALL ".join(map(_parts, ("car", "ogv", "psv", "rail"))), "asg pe lk")
def assignment_costs(s, d):
    """What the assigned flow costs in time, fuel, tolls and fares, by vehicle."""
    links = T.links(s, d)
    p = T.od_paths(s, d)
    steps = inc.incidence(p)
    done = inc.assigned(p, inc.od_adjustment(steps, inc.edge_totals(steps, links)))
    speeds = network.edge_init(links).select("e_id", "metres", F.col("initial_speed").alias("speed"), "toll")
    vehicles, parts = ["car", "ogv", "psv", "rail"], assignment.COST_PARTS
    sums = assignment.paths_costs(done, speeds, vehicles).agg(*[r(F.sum(F.col("assigned") * F.col(f"{c}_{v}")), 0).alias(f"{c}_{v}") for v in vehicles for c in parts])
    rows = F.array(*[F.struct(F.lit(v).alias("vehicle"), *[F.col(f"{c}_{v}").alias(c) for c in parts]) for v in vehicles])
    return sums.select(F.inline(rows))


@query(
    "user_equilibrium",
    "RECURSIVE WITH p AS (SELECT origin, destination, sum(flow) AS q FROM nod GROUP BY 1, 2), "
    "l AS (SELECT origin, destination, k, (10.0 + 5 * k + substr(origin, 2)::INTEGER % 3)::DOUBLE AS t0, (1.0 + 0.3 * (k + 1) * q)::DOUBLE AS c, q FROM p, (VALUES (0), (1)) v(k)), "
    "u AS (SELECT 0 AS n, *, 0.0::DOUBLE AS f, t0 AS t FROM l UNION ALL SELECT n + 1, origin, destination, k, t0, c, q, g, CASE WHEN g <= 0 THEN t0 ELSE t0 * (1 + 0.15 * power(g / c, 4)) END FROM "
    "(SELECT *, f + CASE WHEN n = 0 THEN 1.0 ELSE 2.0 / (n + 3) END * (CASE WHEN row_number() OVER (PARTITION BY origin, destination ORDER BY t, k) = 1 THEN q ELSE 0 END - f) AS g FROM u WHERE n < 6)) "
    "SELECT concat(origin, '>', destination, ':', k) AS e_id, round(f, 3) AS flow, round(t, 3) AS minutes FROM u WHERE n = 6",
    "nod",
)
def user_equilibrium(s, d):
    """Six iterations over two links for each pair of nations that trade."""
    pairs = T.nation_od(s, d).groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))
    k = F.col("k")
    number = F.substring("origin", 2, 9).cast("int")
    links = pairs.select("origin", "destination", "flow", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(
        F.concat("origin", F.lit(">"), "destination", F.lit(":"), k).alias("e_id"), F.concat(F.lit("from "), "origin").alias("from_id"), F.concat(F.lit("to "), "destination").alias("to_id"), (10.0 + 5 * k + number % 3).alias("t0"), (1.0 + 0.3 * (k + 1) * F.col("flow")).alias("capacity")
    )
    trips = pairs.select(F.concat(F.lit("from "), "origin").alias("origin"), F.concat(F.lit("to "), "destination").alias("destination"), "flow")
    out = assignment.user_equilibrium(trips, links, 6, 0.0)
    return out.links.select("e_id", r("flow", 3).alias("flow"), r("time", 3).alias("minutes"))


@query("stored_index_candidates", SQL["path_index_candidates"])
def stored_index_candidates(s, d):
    """The candidates of ``path_index_candidates`` from an index written to the shared folder."""
    folder = f"{shared_folder(s)}/path-index-{uuid.uuid4().hex}"
    path_index.write_path_index(T.od_paths(s, d), folder, 32)
    out = path_index.stored_candidates(s, folder, _damaged(s, d))
    return out.select("event", F.array_join("path", ",").alias("path"), F.array_join("hits", ",").alias("hits"), "n", r("flow", 6).alias("flow"))


@query(
    "split_network",
    "WITH q AS (SELECT c.id, n.id AS line, c.lon AS x, round(sqrt(pow(greatest(n.lon - c.lon, c.lon - n.lon - 10, 0), 2) + pow(n.lat - c.lat, 2)), 9) AS m, n.lon FROM cp c, np n), "
    "s AS (SELECT id, arg_min(line, (m, line)) AS line, min(m) AS m FROM q GROUP BY id HAVING min(m) <= 0.4), "
    "c AS (SELECT DISTINCT s.line, cp.lon - np.lon AS t FROM s JOIN cp ON cp.id = s.id JOIN np ON np.id = s.line WHERE cp.lon > np.lon AND cp.lon < np.lon + 10), "
    "e AS (SELECT line, t FROM c UNION ALL SELECT id, 0.0 FROM np UNION ALL SELECT id, 10.0 FROM np) "
    "SELECT line, (row_number() OVER w - 1)::INTEGER AS piece, round(length, 6) AS length FROM (SELECT line, t, lead(t) OVER (PARTITION BY line ORDER BY t) - t AS length FROM e) WHERE length IS NOT NULL WINDOW w AS (PARTITION BY line ORDER BY t)",
    "cp np",
)
def split_network(s, d):
    """A line east of each nation's place, cut where customers lie near it."""
    lines = T.points(s, d, "nation").select(F.lpad(F.col("id").cast("string"), 3, "0").alias("e_id"), F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")), F.struct((F.col("lon") + 10).alias("x"), F.col("lat").alias("y"))).alias("vertices"))
    points = T.points(s, d, "customer").select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    links, _ = network.network_of_parts(lines, points, 0.4)
    return links.select(F.col("line").cast("long").alias("line"), "piece", r(line_length(F.col("vertices")), 6).alias("length"))
