"""Summaries of flows and damage."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def flow_distribution(flows: DataFrame, flow: str = "flow") -> DataFrame:
    """One row: number, sum, largest, exact median and 99th percentile.

    Values are sorted into ranges, whose counts tell which rows stand at the ranks asked for: no task holds more than a
    range. Between two ranks the value is interpolated. No row gives 0 and nulls.
    """
    ranged = checkpointed(flows.select(F.col(flow).cast("double").alias("v")).where("v IS NOT NULL").repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sorted((r["part"], r["n"]) for r in counts.collect())  # a row a partition
    n = sum(c for _, c in sizes)
    starts = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *(c for _, c in sizes)]), strict=False))
    wanted = {name: (math.floor(q * (n - 1)), q * (n - 1) % 1) for name, q in (("median", 0.5), ("p99", 0.99))} if n else {}
    ranks = sorted({r for lo, _ in wanted.values() for r in (lo, min(lo + 1, n - 1))})
    held = [p for p, c in sizes if any(starts[p] <= r < starts[p] + c for r in ranks)]
    start = F.create_map(*[F.lit(x) for p in held for x in (p, starts[p])]) if held else F.create_map(F.lit(-1), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1 + start[F.col("part")]
    found = {r["rank"]: r["v"] for r in ranged.where(F.col("part").isin(held)).select("v", rank.alias("rank")).where(F.col("rank").isin(ranks)).collect()} if held else {}
    at = {name: found[lo] + (found[min(lo + 1, n - 1)] - found[lo]) * share for name, (lo, share) in wanted.items()}
    return ranged.agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.max("v").alias("largest")).withColumns({k: F.lit(at.get(k)).cast("double") for k in ("median", "p99")})


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's sum and its share in percent."""
    sums = df.groupBy(key).agg(F.sum(value).alias(value))
    return sums.crossJoin(sums.agg(F.sum(value).alias("__all"))).withColumn("share", F.try_divide(F.col(value) * 100, "__all")).drop("__all")


def undirected(df: DataFrame, a: str, b: str, flow: str) -> DataFrame:
    return df.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(flow).alias(flow))


def comparison(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation, mean absolute error, and mean relative error (denominators 1 at least) of two columns."""
    err = F.abs(F.col(x) - F.col(y))
    return df.agg(F.corr(x, y).alias("correlation"), F.avg(err).alias("mae"), F.avg(err / F.greatest(F.col(x), F.lit(1.0))).alias("mape"))


def top(df: DataFrame, flow: str, key: str, k: int) -> DataFrame:
    """The k largest, ties to the smaller key: a top-k report."""
    return df.orderBy(F.desc(flow), key).limit(k)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def repeated_pairs(od: DataFrame) -> DataFrame:
    """One row: how many pairs stand more than once."""
    return od.groupBy("origin", "destination").count().where("count > 1").agg(F.count("*").alias("repeated_pairs"))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def link_metrics(links: DataFrame, depth) -> DataFrame:
    """One row: links, those met, closed and damaged, and the deepest depth."""
    return links.agg(
        F.count("*").alias("links"), F.count_if(depth > 0).alias("met"), F.count_if(F.coalesce("max_speed", F.lit(999.0)) <= 0).alias("closed"),
        F.count_if(F.lower(F.coalesce("damage_level_max", F.lit("no"))) != "no").alias("damaged"), F.coalesce(F.max(depth), F.lit(0.0)).alias("deepest"),
    )


def volume_ratio(flow, capacity, reference=None):
    """Flow over capacity, or over the reference capacity where the own one is not positive; null without either."""
    own = F.when(capacity > 0, capacity)
    return F.try_divide(flow, own if reference is None else F.coalesce(own, F.when(reference > 0, reference)))


def scenario_summary(links: DataFrame, depth, damage: DataFrame, lost: DataFrame, rerouting: dict[str, float]) -> DataFrame:
    """One row an event: link metrics, direct damage, disrupted flow by pair, rerouting costs by mode, and all costs.

    links: event_id and what ``link_metrics`` reads; damage: event_id, damage; lost: event_id, origin, destination, disrupted.
    """
    m = links.groupBy("event_id").agg(
        F.count("*").alias("links"), F.count_if(depth > 0).alias("met"), F.count_if(F.coalesce("max_speed", F.lit(999.0)) <= 0).alias("closed"),
        F.count_if(F.lower(F.coalesce("damage_level_max", F.lit("no"))) != "no").alias("damaged"), F.max(depth).alias("deepest"),
    )
    pairs = lost.groupBy("event_id", "origin", "destination").agg(F.sum("disrupted").alias("f")).groupBy("event_id").agg(F.sum("f").alias("disrupted"))
    cost = damage.groupBy("event_id").agg(F.sum("damage").alias("direct_damage"))
    out = m.join(cost, "event_id", "left").join(pairs, "event_id", "left").fillna(0.0, ["direct_damage", "disrupted"])
    out = out.withColumns({f"rerouting_{k}": F.lit(float(v)) for k, v in rerouting.items()})
    return out.withColumn("combined", F.col("direct_damage") + float(sum(rerouting.values()))).withColumn("shown", shown_cost(F.col("combined")))


def check_summary(summary: DataFrame) -> DataFrame:
    """event_id and problems: rows that cannot be, as more damaged links than links, or a cost below 0."""
    rules = {"no links": F.col("links") <= 0, "more met than links": F.col("met") > F.col("links"), "more damaged than links": F.col("damaged") > F.col("links"), "damage below 0": F.col("direct_damage") < 0, "disrupted below 0": F.col("disrupted") < 0}
    return summary.select("event_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("problems"))


def compare_flows(links: DataFrame, other: DataFrame) -> DataFrame:
    """Links with another model's flow on the same two nodes, 0 where it has none, and the difference."""
    o = other.groupBy("from_id", "to_id").agg(F.sum("flow").alias("other_flow"))
    out = links.join(o, ["from_id", "to_id"], "left").withColumn("other_flow", F.coalesce("other_flow", F.lit(0.0)))
    return out.withColumn("difference", F.col("flow") - F.col("other_flow"))


def against_benchmark(benchmark: DataFrame, totals: DataFrame) -> DataFrame:
    """event_id, expected, total, error in percent; an event without a total has null."""
    out = benchmark.join(totals, "event_id", "left")
    return out.withColumn("error_percent", F.try_divide((F.col("total") - F.col("expected")) * 100, "expected"))


def shown_cost(c):
    """$ with K, M or B, one decimal."""
    a = F.abs(c)
    return F.when(a >= 1e9, F.format_string("$%.1fB", c / 1e9)).when(a >= 1e6, F.format_string("$%.1fM", c / 1e6)).when(a >= 1e3, F.format_string("$%.1fK", c / 1e3)).otherwise(F.format_string("$%.1f", c))
