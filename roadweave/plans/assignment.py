"""Iterated plans: the capacity-constrained assignment, rerouting after an event, and user equilibrium."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cost as cost_of
from ..operators import incidence as inc
from ..operators.paths import find_paths
from ..session import checkpointed


@dataclass
class Assignment:
    """links: e_id, from_id, to_id, weight, capacity, acc_capacity, acc_flow; paths: what went where; isolated: what did not; cost: flow times path cost.

    costs: flow times each of the columns time, fuel and toll that the links have. trees: how many origins' trees each
    round has grown. ways: the first round's path of every pair (origin, destination, cost, path, needs).
    """

    links: DataFrame
    paths: DataFrame | None
    isolated: DataFrame
    cost: float
    iterations: int
    costs: dict[str, float] = field(default_factory=dict)
    trees: list[int] = field(default_factory=list)
    ways: DataFrame | None = None


#: Columns of a link that add up to its weight.
PARTS = ("time", "fuel", "toll")
PAIR = ["origin", "destination"]


def still_good(ways: DataFrame, gone: DataFrame) -> DataFrame:
    """The ways none of whose needed links is gone (e_id); ways that do not know what they need are not among them.

    This is the index from links to what depends on them: only links on a path, or that decide between equal ones, are needed.
    """
    hit = ways.select(*PAIR, F.explode("needs").alias("e_id")).join(gone, "e_id", "left_semi").select(*PAIR).distinct()
    return ways.where("needs IS NOT NULL").join(hit, PAIR, "left_anti")


def capacity_loop(od: DataFrame, links: DataFrame, max_iterations: int = 50, enough: float = 0.99, stagnant: int = 3, known: DataFrame | None = None) -> Assignment:
    """All-or-nothing paths, clipped by the tightest link of each, over and over on what is left.

    Weights never change; a link goes when less than 1 of its capacity, or a thousandth of what it began with, is left. It
    ends when no demand or no path is left, the assigned share is ``enough``, after ``max_iterations``, or after
    ``stagnant`` rounds without progress; what is left is isolated. Every round is a checkpoint and one small action.

    As links only go, a pair keeps its path while the links that it needs are there: a round grows anew only the trees of
    pairs that lost one, and the network is not sent out where there are none. (Most pairs that are left over have lost their
    tightest link, so that saves little within one assignment, and most of the work between several.) ``known`` has ways (``Assignment.ways``) of an
    earlier assignment to the same links, weights and capacities, which are not searched again.
    """
    od = od.groupBy(*PAIR).agg(F.sum("flow").alias("flow"))
    links = checkpointed(links.withColumns({"acc_capacity": F.col("acc_capacity") if "acc_capacity" in links.columns else F.col("capacity"), "acc_flow": F.col("acc_flow") if "acc_flow" in links.columns else F.lit(0.0)}))
    nodes = links.select(F.col("from_id").alias("node")).union(links.select("to_id")).distinct()
    lost = checkpointed(inc.isolated(od.select(*PAIR, "flow"), nodes))
    left = checkpointed(od.select(*PAIR, "flow").exceptAll(lost).where("flow > 0"))
    whole = left.agg(F.coalesce(F.sum("flow"), F.lit(0.0))).first()[0]
    done, idle, cost, rounds, paths, trees, first = 0.0, 0, 0.0, 0, None, [], None
    ways = known
    while whole and not left.isEmpty():
        active = links.where("acc_capacity >= 1 AND acc_capacity / capacity >= 0.001")
        todo = left.select(*PAIR)
        if ways is not None:
            ways = checkpointed(ways.join(todo, PAIR, "left_semi"))
            todo = checkpointed(todo.join(ways, PAIR, "left_anti"))
        trees.append(todo.select("origin").distinct().count())
        if trees[-1]:
            grown = find_paths(todo, active, needs=True)
            ways = checkpointed(grown if ways is None else ways.unionByName(grown))
        first = ways if first is None else first
        # Demand has one row a pair, so a pair's name is its own.
        met = checkpointed(left.join(ways.where("size(path) > 0").drop("needs"), PAIR).withColumn("od_id", F.to_json(F.struct(*PAIR))))
        if met.isEmpty():
            break
        steps = inc.incidence(met)
        totals = inc.edge_totals(steps, active.select("e_id", F.col("acc_capacity").alias("capacity")))
        part = checkpointed(inc.assigned(met, inc.od_adjustment(steps, totals)).withColumn("iteration", F.lit(rounds)))
        paths = part if paths is None else paths.union(part)
        used = inc.edge_flow(part)
        before = active.select("e_id")
        links = checkpointed(links.join(used, "e_id", "left").withColumns({"acc_flow": F.col("acc_flow") + F.coalesce("edge_flow", F.lit(0.0)), "acc_capacity": F.greatest(F.col("acc_capacity") - F.coalesce("edge_flow", F.lit(0.0)), F.lit(0.0))}).drop("edge_flow"))
        gone = before.join(links.where("acc_capacity >= 1 AND acc_capacity / capacity >= 0.001"), "e_id", "left_anti")
        now, spent = part.agg(F.sum("assigned"), F.sum(F.col("assigned") * F.col("cost"))).first()
        left = checkpointed(inc.remaining(left, part))
        ways = still_good(ways, gone)
        done, cost, rounds = done + now, cost + spent, rounds + 1
        idle = idle + 1 if now / whole < 1e-6 else 0
        if done / whole >= enough or rounds >= max_iterations or idle >= stagnant:
            break
    return Assignment(links, paths, lost.union(left), cost, rounds, _costs(paths, links), trees, first)


def _costs(paths: DataFrame | None, links: DataFrame) -> dict[str, float]:
    """Assigned flow times each part of the weight that the links have."""
    parts = [c for c in PARTS if c in links.columns]
    if paths is None or not parts:
        return dict.fromkeys(parts, 0.0)
    on = inc.edge_flow(paths).join(links.select("e_id", *parts), "e_id")
    row = on.agg(*[F.coalesce(F.sum(F.col("edge_flow") * F.col(c)), F.lit(0.0)).alias(c) for c in parts]).first()
    return row.asDict()


def path_costs(paths: DataFrame, links: DataFrame, vehicle: str) -> DataFrame:
    """The paths (od_id, flow, path) with time, fuel, toll and fare of a unit of flow on them.

    links: e_id, metres, speed, toll. Buses and trains pay their waiting once a trip, in ``time``, and a fare by the path's
    length; other vehicles pay for fuel and operation. An empty path costs nothing; links without a speed count nothing.
    """
    of = {c: f"{c}_{vehicle}" for c in COST_PARTS}
    return paths_costs(paths, links, [vehicle]).withColumnsRenamed({v: k for k, v in of.items()})


#: What a unit of flow on a path costs.
COST_PARTS = ("time", "fuel", "toll", "fare")


def paths_costs(paths: DataFrame, links: DataFrame, vehicles: list[str]) -> DataFrame:
    """``path_costs`` of several vehicles in one pass over the paths' steps: time_car, fuel_car and so on."""
    miles = F.col("metres") * F.lit(cost_of.METRE_TO_MILE)
    each, sums = ["metres", "toll"], {}
    for v in vehicles:
        time, fuel = cost_of.operating_cost(miles, F.try_divide(miles, F.col("speed")), v)
        each += [time.alias(f"time_{v}"), fuel.alias(f"fuel_{v}")]
        fare = dict(zip(("psv", "rail"), cost_of.fares(F.col("metres") / 1000), strict=True)).get(v, F.lit(0.0))
        sums |= {f"time_{v}": F.col(f"time_{v}") + cost_of.waiting_cost(v), f"fuel_{v}": F.col(f"fuel_{v}"), f"toll_{v}": F.col("toll"), f"fare_{v}": fare}
    each = links.select("e_id", *each)
    steps = inc.path_cost(inc.incidence(paths.select("od_id", "flow", "path")), each, [c for c in each.columns if c != "e_id"])
    steps = steps.select("od_id", *[c.alias(k) for k, c in sums.items()])
    return paths.join(steps, "od_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in sums})


def reroute(base: Assignment, closed: DataFrame) -> tuple[float, Assignment | None]:
    """The cost of rerouting what used the closed links (e_id): new cost less old cost of the disrupted flow.

    Flow that finds no way drops out of the new cost, so the difference can be negative. Open links keep the capacity
    that the baseline left, and get back what the disrupted paths used of it.
    """
    if base.paths is None:
        return 0.0, None
    gone = closed.select("e_id").distinct()
    hit = inc.incidence(base.paths.select("od_id", F.col("assigned").alias("flow"), "path")).join(gone, "e_id", "left_semi").select("od_id").distinct()
    moved = checkpointed(base.paths.join(hit, "od_id", "left_semi"))
    back = inc.edge_flow(moved)
    open_links = base.links.join(gone, "e_id", "left_anti").join(back, "e_id", "left").withColumn("acc_capacity", F.col("acc_capacity") + F.coalesce("edge_flow", F.lit(0.0))).drop("edge_flow")
    before = moved.agg(F.coalesce(F.sum(F.col("assigned") * F.col("cost")), F.lit(0.0))).first()[0]
    again = capacity_loop(moved.groupBy("origin", "destination").agg(F.sum("assigned").alias("flow")), open_links.withColumn("acc_flow", F.lit(0.0)))
    return again.cost - before, again


@dataclass
class Equilibrium:
    """links: e_id, from_id, to_id, t0, capacity, flow, time; history: the relative gap after each iteration."""

    links: DataFrame
    iterations: int
    converged: bool
    history: list[float]


def user_equilibrium(od: DataFrame, links: DataFrame, max_iterations: int = 500, target_gap: float = 1e-4, alpha: float = 0.15, beta: float = 4.0, search: bool = False) -> Equilibrium:
    """Flows at which no traveller gains by another path, on a directed network, by convex combinations of all-or-nothing loads.

    od: origin, destination, flow; links: e_id, from_id, to_id, t0 (free time), capacity. The first load counts whole, those
    after it by 2 / (k + 2), or with ``search`` by the step at which the line between the flows and the load is least costly. The gap
    is 1 less what the demand would spend on its least paths over what it spends; it ends at ``target_gap`` or below. Demand of one
    place, without a path, or without flow moves nothing. Flows, loads and times are tables; the driver sees four
    sums an iteration (and with ``search`` two rows of slopes), and each iteration is a checkpoint.
    """
    pairs = checkpointed(od.groupBy(*PAIR).agg(F.sum("flow").alias("flow")).where("flow > 0"))
    time = cost_of.bpr_time(F.col("t0"), F.col("flow"), F.col("capacity"), alpha, beta)
    state = checkpointed(links.select("e_id", "from_id", "to_id", F.col("t0").cast("double").alias("t0"), F.col("capacity").cast("double").alias("capacity"), F.lit(0.0).alias("flow")).withColumn("time", time))
    history: list[float] = []
    rounds = 0
    while True:
        ways = find_paths(pairs, state.select("e_id", "from_id", "to_id", F.col("time").alias("weight")), directed=True)
        if rounds:
            least = ways.agg(F.coalesce(F.sum(F.col("flow") * F.col("cost")), F.lit(0.0))).first()[0]
            spent = state.agg(F.coalesce(F.sum(F.col("flow") * F.col("time")), F.lit(0.0))).first()[0]
            history.append(max(0.0, 1 - least / spent) if spent else 0.0)
            if history[-1] <= target_gap or rounds >= max_iterations:
                break
        load = inc.edge_flow(ways, "flow").withColumnRenamed("edge_flow", "load")
        both = checkpointed(state.join(load, "e_id", "left").withColumn("load", F.coalesce("load", F.lit(0.0))))
        step = 1.0 if not rounds else _best_step(both, alpha, beta) if search else 2 / (rounds + 3)
        state = checkpointed(both.withColumn("flow", F.col("flow") + F.lit(step) * (F.col("load") - F.col("flow"))).drop("load").withColumn("time", time))
        rounds += 1
    return Equilibrium(state, rounds, history[-1] <= target_gap, history)


def _best_step(both: DataFrame, alpha: float, beta: float, parts: int = 16) -> float:
    """Where the slope of the total along the line from flow to load, which only rises, passes 0: two aggregates of ``parts`` slopes, then in proportion."""
    low, high = 0.0, 1.0
    way = F.col("load") - F.col("flow")
    for _ in range(2):
        at = [low + (high - low) * i / parts for i in range(parts + 1)]
        slope = list(both.agg(*[F.sum(way * cost_of.bpr_time(F.col("t0"), F.col("flow") + F.lit(x) * way, F.col("capacity"), alpha, beta)).alias(f"s{i}") for i, x in enumerate(at)]).first())
        above = next((i for i, v in enumerate(slope) if (v or 0.0) > 0), None)
        if above is None:
            return high
        if not above:
            return low
        low, high, a, b = at[above - 1], at[above], slope[above - 1] or 0.0, slope[above]
    return low + (high - low) * (-a / (b - a))
