"""The recovery loop: for each mode and day of recovery, what an event disrupts and what rerouting it costs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cost
from ..operators import exposure
from ..operators import incidence as inc
from ..session import checkpointed
from . import assignment

RESULT = "mode string, scenario int, day int, disrupted double, pairs long, before double, after double, rerouting double, isolated double, time double, operate double, toll double"


def _speeds(links: DataFrame) -> DataFrame:
    speed = cost.congestion_speed(F.col("acc_flow"), F.col("initial_speed"), F.col("congestion"), F.col("breakpoint"), F.col("min_speed"))
    return links.withColumn("acc_speed", speed)


def _usable(links: DataFrame, vehicle: str) -> DataFrame:
    """What ``capacity_loop`` takes of the links that have capacity and speed."""
    weight = cost.link_cost(F.col("metres"), F.col("acc_speed"), F.col("toll"), vehicle)
    miles = F.col("metres") * F.lit(cost.METRE_TO_MILE)
    time, operate = cost.operating_cost(miles, F.try_divide(miles, F.col("acc_speed")), vehicle)
    return links.where("acc_capacity > 0 AND acc_speed > 0").select("e_id", "from_id", "to_id", weight.alias("weight"), F.col("acc_capacity").alias("capacity"), time.alias("time"), operate.alias("fuel"), "toll")


def day_links(links: DataFrame, rates: DataFrame, position: int) -> DataFrame:
    """Links with acc_capacity, what a day of recovery leaves: the rate of (asset, level) at the day's place in the table; a closed link has none.

    links: e_id, current_capacity, level, asset, max_speed.
    """
    back = exposure.recovery_capacity(links.withColumn("capacity", F.col("current_capacity")), rates, position).drop("capacity")
    return back.withColumnRenamed("capacity_now", "acc_capacity")


def day_disruption(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The candidates (event, od_id, origin, destination, flow, hits, path) whose flow exceeds the least capacity of their hit links, with ``disrupted``."""
    open_capacity = links.select("e_id", exposure.closed(F.col("acc_capacity"), F.col("max_speed")).alias("capacity"))
    lost = inc.disrupted(candidates, open_capacity)
    return candidates.join(lost, ["event", "od_id"])


def give_back(links: DataFrame, lost: DataFrame) -> DataFrame:
    """Capacity that the disrupted flow no longer takes, and the flow without it; all in whole numbers."""
    on_links = inc.edge_flow(lost, "disrupted").withColumnRenamed("edge_flow", "lost")
    whole = lambda c: F.rint(F.coalesce(c, F.lit(0.0)))
    out = links.join(on_links, "e_id", "left")
    return out.withColumns({"acc_capacity": whole(F.col("acc_capacity")) + whole(F.col("lost")), "acc_flow": whole(F.col("current_flow")) - whole(F.col("lost"))}).drop("lost")


def _unchanged(ways: DataFrame | None, plain: DataFrame, now: DataFrame) -> DataFrame | None:
    """The ways over the plain links that hold over the links as they are now: none if any link is better than it was."""
    if ways is None:
        return None
    was, is_now = (x.where("capacity >= 1").select("e_id", F.col("weight").alias(name)) for x, name in ((plain, "was"), (now, "now")))
    both = checkpointed(was.join(is_now, "e_id", "full"))
    if not both.where("now IS NOT NULL AND (was IS NULL OR now < was)").isEmpty():
        return None
    return checkpointed(assignment.still_good(ways, both.where("now IS NULL OR now > was").select("e_id")))


def recovery(links: DataFrame, candidates: dict[str, DataFrame], rates: DataFrame, days: list[tuple[int, int]], vehicles: dict[str, str] | None = None) -> Iterator[tuple]:
    """A row (RESULT) for each mode of ``candidates`` and each (scenario, day) of recovery.

    links: e_id, from_id, to_id, metres, toll, initial_speed, min_speed, breakpoint, congestion, current_flow,
    current_capacity, max_speed, level, asset, depth. rates: asset, level, day (the place in the table, from 1), rate.
    The disrupted flow is assigned anew, to the links as the day leaves them and to the undisrupted ones; the difference
    of both costs is that of rerouting, of which time, operate and toll are the parts. Flow that finds no way is isolated. A
    mode without candidates gives no row. The undisrupted links are the same every day, so a day searches them only for
    pairs that no day before had; and the day's own links only for pairs that need a link which is closed or slower that day.
    """
    for mode, paths in candidates.items():
        vehicle = (vehicles or {}).get(mode, "car")
        if paths.isEmpty():
            continue
        plain = checkpointed(_usable(_speeds(links.withColumns({"acc_capacity": F.rint("current_capacity"), "acc_flow": F.rint("current_flow")})), vehicle))
        ways = None
        for position, (scenario, day) in enumerate(days, 1):
            of_day = day_links(links, rates, position)
            lost = checkpointed(day_disruption(paths, of_day))
            pairs = lost.groupBy("origin", "destination").agg(F.sum("disrupted").alias("flow"))
            state = _speeds(give_back(of_day, lost))
            state = state.withColumn("acc_speed", exposure.day_gate(day, F.col("acc_speed"), F.col("max_speed"), F.col("depth")))
            before = assignment.capacity_loop(pairs, plain, known=ways)
            if before.ways is not None:
                ways = before.ways if ways is None else checkpointed(ways.join(before.ways, assignment.PAIR, "left_anti").unionByName(before.ways))
            now = checkpointed(_usable(state, vehicle))
            after = assignment.capacity_loop(pairs, now, known=_unchanged(ways, plain, now))
            total = pairs.agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("f"), F.count("*").alias("n")).first()
            isolated = inc.isolation(after.isolated).agg(F.coalesce(F.sum("flow"), F.lit(0.0))).first()[0] if after.isolated is not None else 0.0
            yield mode, scenario, day, float(total["f"]), total["n"], float(before.cost), float(after.cost), float(after.cost - before.cost), float(isolated), *(float(after.costs[c] - before.costs[c]) for c in assignment.PARTS)


def recovery_table(links: DataFrame, candidates: dict[str, DataFrame], rates: DataFrame, days: list[tuple[int, int]], vehicles: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``recovery`` as a table: a row a mode and day."""
    return links.sparkSession.createDataFrame(list(recovery(links, candidates, rates, days, vehicles)), RESULT)
