"""Exposure of links, their damage and its cost, capacities in recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import damage


def dedupe_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row a segment: the largest of every other numeric column."""
    numeric = [f.name for f in segments.schema.fields if f.name not in keys and f.dataType.typeName() in ("double", "float", "integer", "long")]
    return segments.groupBy(*keys).agg(*[F.max(c).alias(c) for c in numeric])


def link_exposure(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Every link with its largest intensity and level number, 0 where it is not exposed."""
    worst = segments.groupBy("e_id").agg(F.max("intensity").alias("intensity"), F.max("level").alias("level"))
    return links.join(worst, "e_id", "left").withColumns({"intensity": F.coalesce("intensity", F.lit(0.0)), "level": F.coalesce("level", F.lit(0))})


def edge_damage(segments: DataFrame) -> DataFrame:
    """e_id, damage summed, worst level, and the road label of the first segment by id."""
    return segments.groupBy("e_id").agg(F.sum("damage").alias("damage"), F.max("level").alias("level"), F.min_by("road_label", "segment_id").alias("road_label"))


def recovery_capacity(links: DataFrame, rates: DataFrame, day: int) -> DataFrame:
    """Capacity of damaged links on a day: design capacity times the rate of (asset, level, day); others keep theirs."""
    of_day = rates.where(F.col("day") == day).select("asset", "level", "rate")
    out = links.join(F.broadcast(of_day), ["asset", "level"], "left")
    return out.withColumn("capacity_now", F.when(F.col("level") == "no", F.col("capacity")).otherwise(F.col("capacity") * F.coalesce("rate", F.lit(0.0)))).drop("rate")


def closed(capacity: Column, max_speed: Column) -> Column:
    """No capacity where the speed cap is 0; no cap counts as open."""
    return F.when(F.coalesce(max_speed, F.lit(999.0)) <= 0, F.lit(0.0)).otherwise(capacity)


def day_gate(day: int, speed: Column, cap: Column, depth: Column) -> Column:
    """The cap holds on day 1 everywhere, on day 2 for depths from 2 to under 6, on day 3 from 6."""
    gate = {1: F.lit(True), 2: (depth >= 2) & (depth < 6), 3: depth >= 6}.get(day, F.lit(False))
    return F.when(gate & cap.isNotNull(), F.least(speed, cap)).otherwise(speed)


def damaged(levels: list[Column], depth: Column | None = None) -> Column:
    """A level other than no; without levels a depth above 0."""
    if levels:
        out = F.lit(False)
        for c in levels:
            out = out | (F.coalesce(c, F.lit("no")) != "no")
        return out
    return F.coalesce(depth, F.lit(0.0)) > 0


def segment_levels(segments: DataFrame, hazard: str, value: str = "intensity") -> DataFrame:
    """Segments (road_class) with level number and level_name."""
    n = damage.class_ordinal(F.col(value), hazard, F.col("road_class"))
    return segments.withColumns({"level": n, "level_name": damage.level_name(n)})
