"""From segments that a hazard meets to links with intensity, level and speed cap, and the damaged links of events."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import damage, keys
from . import exposure

#: Each hazard's unit of intensity, its column, and what makes a depth of it for the damage curves.
HAZARDS = {
    "flood": ("m_depth", "flood_depth_max", 1.0),
    "snow": ("mm_snow", "snow_depth_max_mm", 1e-3),
    "earthquake": ("g_pga", "pga_max_g", 0.5),
    "landslide": ("mm_displacement", "landslide_max_mm", 1e-3),
    "winter_storm": ("mm_ice", "winter_storm_max_mm", 1e-3),
}
#: Hazards whose closure is a matter of depth; the others' speeds fall by level.
BY_DEPTH = ("flood", "snow", "winter_storm")


@dataclass(frozen=True)
class Hazard:
    """What a hazard does to roads, in column expressions.

    ``depth`` makes of (a part's value, the part's name, road class, an embankment given or None) what levels and caps are
    read from; ``level`` makes a number from 0 to 4 of (depth, part's name, road class); ``cap`` makes the speed that is
    left of (free-flow speed, worst depth, level's name, closure threshold).
    """

    unit: str
    column: str
    to_depth: float
    level: Callable[[Column, str, Column], Column]
    cap: Callable[[Column, Column, Column, Column], Column]
    depth: Callable[[Column, str, Column, float | None], Column] = lambda value, part, road, offset: value


def _by_depth(scale: float) -> Callable[[Column, Column, Column, Column], Column]:
    return lambda free, x, level, threshold: damage.speed_cap_quadratic(free, x * scale, threshold)


def by_level(free: Column, x: Column, level: Column, threshold: Column) -> Column:
    """The share of the free-flow speed that a level leaves."""
    return damage.speed_cap_step(free, level)


def _built_in(name: str) -> Hazard:
    unit, column, to_depth = HAZARDS[name]
    cap = _by_depth(100.0 if name == "flood" else 1.0) if name in BY_DEPTH else by_level
    if name == "flood":
        return Hazard(unit, column, to_depth, damage.class_ordinal, cap, damage.embanked)
    return Hazard(unit, column, to_depth, lambda x, part, road: damage.class_ordinal(x, name, road), cap)


_REGISTRY: dict[str, Hazard] = {}


def register_hazard(name: str, hazard: Hazard) -> None:
    """Makes a hazard known to ``run_disruption`` and ``link_disruption``; a name that is taken, a built-in one too, raises ValueError."""
    if name in HAZARDS or _REGISTRY.get(name, hazard) != hazard:
        raise ValueError(f"there is a hazard {name}")
    _REGISTRY[name] = hazard


def hazard_of(name: str) -> Hazard:
    """The registered or built-in hazard of a name; others raise KeyError."""
    if name in HAZARDS:
        return _built_in(name)
    if name not in _REGISTRY:
        raise KeyError(f"no hazard {name}; there are {', '.join([*HAZARDS, *_REGISTRY])}")
    return _REGISTRY[name]


def stepped(limits: Iterable[float]) -> Callable[[Column, str, Column], Column]:
    """Levels 1, 2, ... from these intensities up; missing intensities are level 0."""
    limits = list(limits)

    def level(x: Column, part: str, road: Column) -> Column:
        out = F.lit(0)
        for n, limit in enumerate(limits, 1):
            out = F.when(F.coalesce(x, F.lit(0.0)) >= limit, n).otherwise(out)
        return out

    return level


#: Columns of an assignment's state, which links take from the baseline.
STATE = ("acc_flow", "acc_capacity", "acc_speed", "current_flow", "current_capacity", "current_speed", "free_flow_speeds", "initial_speed", "min_speed", "breakpoint")
SEGMENT = ["e_id", "split_id", "i", "j"]


def only_cells(segments: DataFrame) -> DataFrame:
    """Without the rows of segments that lie in no cell: i and j are -1."""
    return segments.where(~((F.col("i") == -1) & (F.col("j") == -1)))


def only_damaged(segments: DataFrame, levels: Iterable[str]) -> DataFrame:
    """Without the rows whose levels are all no."""
    return segments.where(exposure.damaged([F.col(c) for c in levels]))


def merge_exposures(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """One row a segment with a column for each part's value (the largest), null where a part does not have the segment.

    Rows are united and aggregated, which is the full outer join on all keys without a join.
    """
    wide = [p.select(*SEGMENT, *[(F.col("value") if n == name else F.lit(None)).cast("double").alias(n) for n in names]) for p, name in zip(parts, names, strict=True)]
    return functools.reduce(DataFrame.union, wide).groupBy(*SEGMENT).agg(*[F.max(n).alias(n) for n in names])


def flood_levels(segments: DataFrame, hazard: str, offset: float | None = None) -> DataFrame:
    """Segments (road_class, value) with depth, the value less the embankment, and its level number."""
    depth = damage.embanked(F.col("value"), hazard, F.col("road_class"), offset)
    return segments.withColumn("depth", depth).withColumn("level", damage.class_ordinal(F.col("depth"), hazard, F.col("road_class")))


def intensity_levels(segments: DataFrame, hazard: str) -> DataFrame:
    return segments.withColumn("depth", F.col("value")).withColumn("level", damage.class_ordinal(F.col("value"), hazard, F.col("road_class")))


def worst_of(columns: list[Column]) -> Column:
    """The largest of what is there; null if nothing is."""
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def with_state(links: DataFrame, baseline: DataFrame) -> DataFrame:
    """Links with the baseline's state: their own columns of that name go first; a link that the baseline lacks has nulls."""
    state = [c for c in STATE if c in baseline.columns]
    return links.drop(*STATE).join(baseline.select("e_id", *state), "e_id", "left")


def prefer_current(df: DataFrame) -> DataFrame:
    """acc_ columns give way to current_ columns of the same name; those without a rival take that name."""
    have = set(df.columns)
    drop = [c for c in df.columns if c.startswith("acc_") and "current_" + c[4:] in have]
    rename = {c: "current_" + c[4:] for c in df.columns if c.startswith("acc_") and c not in drop}
    return df.drop(*drop).withColumnsRenamed(rename)


def link_disruption(links: DataFrame, segments: DataFrame, baseline: DataFrame, hazard: str, threshold: float, event_id: str, key: int) -> DataFrame:
    """Every link with the hazard's worst depth and level on it, the baseline's state, its speed cap, and the event's columns.

    ``segments`` have e_id, depth and level, as ``flood_levels`` and ``intensity_levels`` give them. Links that the hazard
    does not meet have depth 0 and level no; a free-flow speed that is not known counts as 50.
    """
    kind = hazard_of(hazard)
    worst = segments.groupBy("e_id").agg(F.max("depth").alias("__x"), F.max("level").alias("__n"))
    out = with_state(links.drop(kind.column, "damage_level_max", "max_speed"), baseline).join(worst, "e_id", "left")
    free = F.coalesce(F.col("free_flow_speeds") if "free_flow_speeds" in out.columns else F.lit(None).cast("double"), F.lit(50.0))
    x, level = F.coalesce("__x", F.lit(0.0)), damage.level_name(F.coalesce("__n", F.lit(0)))
    cap = kind.cap(free, x, level, F.lit(float(threshold)))
    more = {
        "free_flow_speeds": free, kind.column: x, "damage_level_max": level, "max_speed": cap, "hazard_type": F.lit(hazard), "event_id": F.lit(str(event_id)),
        "scenario_param": F.lit(int(key)), "intensity_primary": x, "intensity_unit": F.lit(kind.unit),
    }
    if hazard != "flood":
        more["flood_depth_max"] = x * kind.to_depth
    return out.withColumns(more).drop("__x", "__n")


def depth_equivalent(df: DataFrame) -> Column:
    """A row's intensity in metres, from the columns that the table has."""
    if "intensity_primary" in df.columns:
        x = F.coalesce("intensity_primary", F.lit(0.0))
        return F.when(F.col("intensity_unit").contains("snow"), x / 1000).otherwise(x) if "intensity_unit" in df.columns else x
    if "snow_depth_max_mm" in df.columns:
        return F.coalesce("snow_depth_max_mm", F.lit(0.0)) / 1000
    return F.coalesce("flood_depth_max", F.lit(0.0)) if "flood_depth_max" in df.columns else F.lit(0.0)


def run_disruption(links: DataFrame, parts: dict[str, DataFrame], baseline: DataFrame, hazard: str, threshold: float, event_id: str, key: int, offset: float | None = None) -> DataFrame:
    """Hazard to links: each part's cells (SEGMENT keys, value), of one type of flood or of the hazard itself, get levels by
    the links' classes; a segment takes the worst of its parts; links take the worst of their segments."""
    road = links.select("e_id", F.col("road_class"))
    names = list(parts)
    kind = hazard_of(hazard)
    merged = only_cells(merge_exposures([parts[n] for n in names], names)).join(road, "e_id")
    for n in names:
        merged = merged.withColumn(f"{n}_depth", kind.depth(F.col(n), n, F.col("road_class"), offset))
        merged = merged.withColumn(f"{n}_level", kind.level(F.col(f"{n}_depth"), n, F.col("road_class")))
    worst = merged.select("e_id", worst_of([F.col(f"{n}_depth") for n in names]).alias("depth"), worst_of([F.col(f"{n}_level") for n in names]).alias("level"))
    return link_disruption(links, worst, baseline, hazard, threshold, event_id, key)


def records(df: DataFrame, extra: list[str]) -> DataFrame:
    """Rows of disruption records: the fixed fields, then those of the map ``extra`` that are named, null where missing."""
    fixed = ["e_id", "hazard_type", "event_id", "scenario_param", "intensity_primary", "intensity_unit", "max_speed", "damage_level_max"]
    return df.select(*fixed, *[F.try_element_at("extra", F.lit(k)).alias(k) for k in extra])


def export_damaged(links: DataFrame) -> DataFrame:
    """event_id, e_id, damage_level of the damaged links, once each. By level if the table has one, else by depth."""
    has = "damage_level_max" in links.columns
    hit = exposure.damaged([F.lower("damage_level_max")]) if has else exposure.damaged([], F.col("flood_depth_max"))
    level = F.col("damage_level_max") if has else F.lit(None).cast("string")
    return links.where(hit).groupBy("event_id", F.col("e_id").cast("string").alias("e_id")).agg(F.min(level).alias("damage_level"))


def load_damaged(rows: DataFrame, network: DataFrame) -> DataFrame:
    """event_id, e_id of a table of damaged links, once each, of links that the network has.

    The event is event_id, else depth_key and flood_key joined, else whichever of them there is, else event_000001.
    """
    if "e_id" not in rows.columns:
        raise ValueError("damaged links need e_id")
    have = [c for c in ("depth_key", "flood_key") if c in rows.columns]
    event = F.col("event_id").cast("string") if "event_id" in rows.columns else F.concat_ws("_", *[F.col(c).cast("string") for c in have]) if have else F.lit(None).cast("string")
    out = rows.select(keys.safe_event_id(event).alias("event_id"), F.col("e_id").cast("string").alias("e_id"))
    return out.join(network.select(F.col("e_id").cast("string").alias("e_id")), "e_id", "left_semi").select("event_id", "e_id").distinct()


def with_labels(links: DataFrame, levels: DataFrame) -> DataFrame:
    """Links with the levels' columns; where both have one, the levels' value comes first."""
    both = [c for c in levels.columns if c != "e_id" and c in links.columns]
    new = [c for c in levels.columns if c != "e_id" and c not in both]
    right = levels.select("e_id", *new, *[F.col(c).alias(f"__{c}") for c in both])
    out = links.join(right, "e_id", "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in both}).drop(*[f"__{c}" for c in both]) if both else out
