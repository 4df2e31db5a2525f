"""Paths and links: incidence, edge totals, the capacity clip, candidates of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, whole

#: Columns of costs of a path.
COSTS = ("cost", "fuel", "time", "toll", "fare", "metres", "length")


def incidence(paths: DataFrame) -> DataFrame:
    """(od_id, flow, pos, e_id) of every step of every path: od_id, flow, path array<e_id>. Links visited twice stand twice."""
    return paths.select("od_id", "flow", F.posexplode("path").alias("pos", "e_id"))


def edge_totals(steps: DataFrame, capacity: DataFrame) -> DataFrame:
    """e_id, total_flow, capacity of the links on paths; a link without a capacity has null and limits nothing."""
    return steps.groupBy("e_id").agg(F.sum("flow").alias("total_flow")).join(capacity.select("e_id", "capacity"), "e_id", "left")


def od_adjustment(steps: DataFrame, totals: DataFrame) -> DataFrame:
    """od_id, adjust: the smallest share of its flow that any link on the path can take, 1 at most."""
    share = totals.select("e_id", F.least(F.try_divide("capacity", "total_flow"), F.lit(1.0)).alias("ratio"))
    return steps.join(share, "e_id").groupBy("od_id").agg(F.min("ratio").alias("adjust"))


def assigned(paths: DataFrame, adjustment: DataFrame) -> DataFrame:
    """The paths with adjust (1 where no link limits) and assigned flow."""
    out = paths.join(adjustment, "od_id", "left").withColumn("adjust", F.coalesce("adjust", F.lit(1.0)))
    return out.withColumn("assigned", F.col("flow") * F.col("adjust"))


def edge_flow(paths: DataFrame, flow: str = "assigned") -> DataFrame:
    """e_id, edge_flow: a path's flow counts at each of its steps."""
    return paths.select(F.explode("path").alias("e_id"), F.col(flow).alias("f")).groupBy("e_id").agg(F.sum("f").alias("edge_flow"))


def path_cost(steps: DataFrame, attributes: DataFrame, columns: list[str]) -> DataFrame:
    """od_id and the sums of the links' columns along each path."""
    return steps.join(attributes.select("e_id", *columns), "e_id").groupBy("od_id").agg(*[F.sum(c).alias(c) for c in columns])


def remaining(od: DataFrame, done: DataFrame) -> DataFrame:
    """origin, destination, flow: what of the demand is not assigned yet, positive rows only."""
    used = done.groupBy("origin", "destination").agg(F.sum("assigned").alias("used"))
    left = F.greatest(F.col("flow") - F.coalesce("used", F.lit(0.0)), F.lit(0.0))
    return od.join(used, ["origin", "destination"], "left").select("origin", "destination", left.alias("flow")).where("flow > 0")


def isolated(od: DataFrame, nodes: DataFrame) -> DataFrame:
    """Demand with an end that is no node: two anti-joins, as NOT IN would be empty at the first null."""
    n = nodes.select("node").where("node IS NOT NULL").distinct()
    good = od.join(n, od["origin"] == n["node"], "left_semi")
    good = good.join(n, good["destination"] == n["node"], "left_semi")
    return od.exceptAll(good)


def merge_paths(paths: DataFrame) -> DataFrame:
    """One row for each (origin, destination, path): smallest od_id, summed flow, and the least of any cost columns."""
    costs = [F.min(c).alias(c) for c in paths.columns if c in COSTS]
    return paths.groupBy("origin", "destination", "path").agg(F.min("od_id").alias("od_id"), F.sum("flow").alias("flow"), *costs)


def total_costs(paths: DataFrame, flow: str = "assigned") -> DataFrame:
    """One row: the flow, and each cost column times the flow, 0 where there is none."""
    sums = [F.coalesce(F.sum(F.col(flow) * F.col(c)), F.lit(0.0)).alias(c) for c in paths.columns if c in COSTS]
    return paths.agg(F.coalesce(F.sum(flow), F.lit(0.0)).alias("flow"), *sums)


def origin_lists(od: DataFrame) -> DataFrame:
    """origin, destinations and flows: an origin's demand as two lists in the order of destinations."""
    both = F.array_sort(F.collect_list(F.struct("destination", "flow")))
    return od.groupBy("origin").agg(both.alias("x")).select("origin", F.col("x.destination").alias("destinations"), F.col("x.flow").alias("flows"))


def isolation(od: DataFrame) -> DataFrame:
    """origin, destination, flow of demand that found no way: summed, without pairs of one place and without flow."""
    return od.where("origin <> destination").groupBy("origin", "destination").agg(F.sum("flow").alias("flow")).where("flow > 0")


def disrupted_by_pair(lost: DataFrame) -> DataFrame:
    """One row an event: disrupted flow in all, summed by pair first, and the pairs."""
    pairs = lost.groupBy("event", "origin", "destination").agg(F.sum("disrupted").alias("f"))
    return pairs.groupBy("event").agg(F.count("*").alias("pairs"), F.sum("f").alias("disrupted"))


def edge_ids(c):
    """A path as array<string> from text like "[a, 'b']" or "a, b"; nulls, blanks and nan are left out."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]()'\"]", ""), r"[,\s]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: (s != "") & ~F.lower(s).isin("nan", "none", "null"))


def event_candidates(paths: DataFrame, damaged: DataFrame) -> DataFrame:
    """Paths that meet an event's damaged links (event, e_id): event, od_id, hits in path order, repeats kept."""
    steps = incidence(paths).join(damaged, "e_id")
    hits = F.transform(F.array_sort(F.collect_list(F.struct("pos", "e_id"))), lambda s: s["e_id"])
    return steps.groupBy("event", "od_id").agg(hits.alias("hits"), F.first("flow").alias("flow"))


def disrupted(candidates: DataFrame, capacity: DataFrame) -> DataFrame:
    """event, od_id, disrupted flow: what exceeds the smallest capacity left on the hit links; positive rows only.

    Links without a capacity limit nothing; a path whose hit links all have none is not disrupted.
    """
    per_hit = candidates.select("event", "od_id", "flow", F.explode(F.array_distinct("hits")).alias("e_id")).join(capacity, "e_id", "left")
    least = per_hit.groupBy("event", "od_id").agg(F.first("flow").alias("flow"), F.min("capacity").alias("least"))
    out = F.col("flow") - F.col("least")
    return least.select("event", "od_id", out.alias("disrupted")).where("disrupted > 0")


def disrupted_paths(paths: DataFrame, damaged: DataFrame, capacity: DataFrame, columns: list[str]) -> DataFrame:
    """``disrupted`` of the paths' ``event_candidates``, with the paths' ``columns``; an od_id is one path.

    The damaged links carry their capacity to the steps, and where they are few enough for every executor, no step is shuffled if the paths are parted by od_id.
    """
    hits = checkpointed(damaged.join(capacity, "e_id").groupBy("event", "e_id").agg(F.min("capacity").alias("capacity")).where("capacity IS NOT NULL"))
    steps = paths.select("od_id", "flow", *columns, F.explode("path").alias("e_id")).join(whole(hits), "e_id")
    least = steps.groupBy("event", "od_id", *columns).agg((F.first("flow") - F.min("capacity")).alias("disrupted"))
    return least.select("event", "od_id", *columns, "disrupted").where("disrupted > 0")


def path_index(paths: DataFrame) -> DataFrame:
    """A path written once: path_id (128 bits of its links' hash), path, and the number of trips on it."""
    return paths.groupBy(F.md5(F.to_json(F.struct("path"))).alias("path_id"), "path").agg(F.count("*").alias("n"), F.sum("flow").alias("flow"))


def index_candidates(index: DataFrame, damaged: DataFrame) -> DataFrame:
    """event, path_id, hits, path, n, flow: paths of the index that hold an event's damaged links, with those in the path's order, once each.

    A path goes along with its steps, which are shuffled only if the damaged links are too many for every executor.
    """
    damaged = checkpointed(damaged)
    links = index.select("path_id", "path", "n", "flow", F.posexplode(F.array_distinct("path")).alias("pos", "e_id"))
    hits = F.transform(F.array_sort(F.collect_list(F.struct("pos", "e_id"))), lambda s: s["e_id"])
    met = links.join(whole(damaged), "e_id").groupBy("event", "path_id", "path").agg(hits.alias("hits"), F.first("n").alias("n"), F.first("flow").alias("flow"))
    return met.select("event", "path_id", "hits", "path", "n", "flow")
