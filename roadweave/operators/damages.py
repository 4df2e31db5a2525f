"""Direct damage of segments: their links' attributes, curves by class, unit costs by key, and what it comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import damage
from .disruption import only_cells

TYPES = ("surface", "river")
#: What a link has where a column or value is missing; cost tables are in millions.
DEFAULTS = {"road_label": "road", "form_of_way": "Single Carriageway", "trunk_road": False, "urban": 0, "lanes": 2, "width": 3.65}
MILLION = 1_000_000.0


def with_attributes(links: DataFrame) -> DataFrame:
    """Links with road_class and the columns of DEFAULTS; a bridge flag stands in for a label; labels other than road, bridge and tunnel are road."""
    label = F.col("road_label") if "road_label" in links.columns else F.when(F.lower("road_bridge") == "yes", "bridge") if "road_bridge" in links.columns else F.lit(None).cast("string")
    label = F.lower(F.coalesce(label, F.lit("road")))
    rest = {c: F.coalesce(F.col(c), F.lit(v)) if c in links.columns else F.lit(v) for c, v in DEFAULTS.items() if c != "road_label"}
    return links.select("e_id", "road_class", F.when(label.isin("road", "bridge", "tunnel"), label).otherwise("road").alias("road_label"), *[v.alias(c) for c, v in rest.items()])


def format_segments(segments: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each e_id, length, i and j: the deepest depth and worst level by type, and the link's attributes.

    Rows that lie in no cell go; missing depths are 0 and missing levels no.
    """
    depth = [F.max(F.coalesce(F.col(f"depth_{t}"), F.lit(0.0)) if f"depth_{t}" in segments.columns else F.lit(0.0)).alias(f"depth_{t}") for t in TYPES]
    level = [damage.level_name(F.max(damage.level_number(F.coalesce(F.col(f"level_{t}"), F.lit("no"))) if f"level_{t}" in segments.columns else F.lit(0))).alias(f"level_{t}") for t in TYPES]
    worst = only_cells(segments).groupBy("e_id", "length", "i", "j").agg(*depth, *level)
    return worst.join(with_attributes(links), "e_id", "left")


def _curve(curves: dict[str, list[tuple[float, float]]], first: Column, second: int, depth: Column) -> Column:
    out = F.lit(None).cast("double")
    for n in (1, 3, 5):
        out = F.when(first == n, damage.fraction(depth, curves[f"C{n + second}"])).otherwise(out)
    return out


def damage_costs(segments: DataFrame, costs: DataFrame, curves: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """``format_segments`` rows with, for each type, the pair of curves (1, 3 or 5), both fractions, and the least, largest and mean cost of each.

    costs: asset (road, tunnel, bridge_surface, bridge_river), key (a key of ``damage.cost_key`` or a fallback label; a
    level for bridges), low, high, in millions a unit. A road's key that the table lacks falls back to its class's label.
    """
    table = costs.groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("low", "high")))).alias("m"))
    table = F.broadcast(table.agg(F.map_from_entries(F.collect_list(F.struct("asset", "m"))).alias("__costs")))  # the cost table, some dozen rows
    out = segments.crossJoin(table)  # one row
    own = damage.cost_key(F.col("road_class"), F.col("form_of_way"), F.col("lanes"), F.col("urban"))
    for t in TYPES:
        depth = F.col(f"depth_{t}")
        pair = damage.curve_pair(F.col("road_class"), F.col("trunk_road"), F.col("road_label"))
        asset = F.when(F.col("road_label") == "bridge", f"bridge_{t}").otherwise(F.col("road_label"))
        units = F.try_element_at("__costs", asset)
        key = F.when(F.col("road_label") == "bridge", F.col(f"level_{t}")).when(F.map_contains_key(units, own), own).otherwise(damage.fallback_key(F.col("road_class")))
        unit = F.try_element_at(units, key)
        out = out.withColumn(f"pair_{t}", pair)
        for n, name in enumerate("ab"):
            share = _curve(curves, pair, n, depth)
            out = out.withColumn(f"fraction_{t}_{name}", share)
            for side in ("low", "high"):
                road = damage.road_cost(F.col("length"), F.col("lanes"), unit[side], share)
                out = out.withColumn(f"{side}_{t}_{name}", F.when(F.col("road_label") == "bridge", damage.bridge_cost(F.col("width"), F.col("length"), unit[side])).otherwise(road))
            out = out.withColumn(f"mean_{t}_{name}", (F.col(f"low_{t}_{name}") + F.col(f"high_{t}_{name}")) / 2)
    return out.drop("__costs")


def direct_damage(costs: DataFrame) -> DataFrame:
    """With direct_damage_musd and direct_damage_usd: the mean of a type's pair of curves, summed over types."""
    both = damage.consolidated([[(F.col(f"mean_{t}_a"), F.col(f"mean_{t}_b"))] for t in TYPES])
    return costs.withColumn("direct_damage_musd", both).withColumn("direct_damage_usd", F.col("direct_damage_musd") * MILLION)


def all_means(costs: DataFrame) -> Column:
    """The older total: every mean column summed, which counts both curves of a pair."""
    means = [F.coalesce(c, F.lit(0.0)) for c in costs.columns if c.startswith("mean_")]
    return sum(means[1:], means[0])


def event_summary(costs: DataFrame, key: str = "event_id", **more: Column) -> DataFrame:
    """A row an event: segments, links, damage, and its least and largest, which are the mean too; ``more`` aggregates by name."""
    named = [c.alias(n) for n, c in more.items()]
    out = costs.groupBy(key).agg(F.count("*").alias("segments"), F.countDistinct("e_id").alias("links"), F.sum("direct_damage_usd").alias("damage"), *named)
    return out.withColumns({"damage_low": F.col("damage"), "damage_high": F.col("damage")})
