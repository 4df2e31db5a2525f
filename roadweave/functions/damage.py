"""Damage levels, speed caps, damage fractions and costs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cost import clean_class, is_major

LEVELS = ("no", "minor", "moderate", "extensive", "severe")
# Thresholds of minor, moderate, extensive and severe for (major, other) roads; flood in cm, snow, landslide and ice in mm, quakes in g.
THRESHOLDS = {
    "surface": ((200, 600, None, None), (50, 600, None, None)),
    "river": ((50, 100, 200, 600), (0, 50, 200, 600)),
    "coastal": ((40, 90, 180, 500), (30, 80, 150, 400)),
    "snow": ((75, 150, 300, 600), (50, 100, 200, 400)),
    "earthquake": ((0.15, 0.25, 0.35, 0.45), (0.10, 0.18, 0.28, 0.38)),
    "landslide": ((25, 75, 150, 300), (15, 50, 100, 200)),
    "winter_storm": ((40, 80, 150, 250), (25, 60, 120, 200)),
}
FLOODS = ("surface", "river", "coastal")
#: What a level leaves of a link's free-flow speed.
SPEED_SHARE = {"no": 1.0, "minor": 0.85, "moderate": 0.5, "extensive": 0.0, "severe": 0.0}


#: The classes that floods can damage; for these hazards tertiary roads are major too.
DAMAGEABLE = ("motorway", "motorway_link", "trunk", "primary", "secondary", "tertiary", "service", "unclassified", "local")
WIDER_MAJOR = ("earthquake", "landslide", "winter_storm")


def class_ordinal(value: Column, hazard: str, road_class: Column) -> Column:
    """0 to 4 for an intensity on a road of a class; floods do not damage classes that are not known."""
    hazard = "river" if hazard == "flood" else hazard
    out = ordinal(value, hazard, is_major(road_class, *(("tertiary",) if hazard in WIDER_MAJOR else ())))
    return F.when(clean_class(road_class).isin(*DAMAGEABLE), out).otherwise(0) if hazard in FLOODS else out


def ordinal(value: Column, hazard: str, major: Column) -> Column:
    """0 to 4 for an intensity (floods in metres). On minor roads any depth of river flood is damage."""
    hazard = "river" if hazard == "flood" else hazard
    x = F.coalesce(value, F.lit(0.0)) * (100.0 if hazard in FLOODS else 1.0)
    steps = []
    for levels in THRESHOLDS[hazard]:
        out = F.lit(0)
        for i, limit in enumerate(levels, 1):
            if limit is not None:
                out = F.when(x > 0 if limit == 0 else x >= limit, F.lit(i)).otherwise(out)
        steps.append(out)
    return F.when(major, steps[0]).otherwise(steps[1])


def level_name(n: Column) -> Column:
    out = F.lit("no")
    for i, name in enumerate(LEVELS):
        out = F.when(n == i, name).otherwise(out)
    return out


def level_number(name: Column) -> Column:
    out = F.lit(0)
    for i, n in enumerate(LEVELS):
        out = F.when(F.lower(F.trim(name)) == n, i).otherwise(out)
    return out


def speed_cap_quadratic(free: Column, value: Column, threshold: Column) -> Column:
    """Speed left below the closure threshold: free * (value / threshold - 1)**2; none beyond it."""
    f, x = F.coalesce(free, F.lit(50.0)), F.coalesce(value, F.lit(0.0))
    return F.when(x < threshold, f * F.pow(x / threshold - 1, F.lit(2.0))).otherwise(F.lit(0.0))


def speed_cap_step(free: Column, level: Column) -> Column:
    out = F.lit(1.0)
    for name, share in SPEED_SHARE.items():
        out = F.when(F.lower(level) == name, share).otherwise(out)
    return F.coalesce(free, F.lit(50.0)) * out


def fraction(x: Column, curve: list[tuple[float, float]]) -> Column:
    """The piecewise linear curve's value, its ends' values beyond them; nulls stay null."""
    points = sorted(curve)
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(points[-1][1]))))


def bridge_cost(width: Column, length: Column, unit: Column) -> Column:
    return width * length * unit


def road_cost(length: Column, lanes: Column, unit: Column, share: Column) -> Column:
    return length * 1e-3 * lanes * unit * share


def consolidated(types: list[list[tuple[Column, Column]]]) -> Column:
    """For each type of flood the mean of what the first pair of curves with a value has, 0 if none has one; summed over types."""
    out = F.lit(0.0)
    for pairs in types:
        out = out + F.coalesce(*[(F.coalesce(a, b) + F.coalesce(b, a)) / 2 for a, b in pairs], F.lit(0.0))
    return out


#: Labels of the cost tables that stand in where a key is missing.
FALLBACK_LABELS = {"Interstate": ("motorway", "motorway_link", "trunk", "interstate"), "US Route": ("primary", "secondary", "us route"), "State Route": ("tertiary", "service", "state route")}


def curve_pair(road_class: Column, trunk: Column, label: Column) -> Column:
    """1, 3 or 5: the first of the pair of curves of tunnels on major roads, of other major roads, of the rest."""
    major = is_major(road_class) | F.coalesce(trunk, F.lit(False))
    return F.when(major & (label == "tunnel"), 1).when(major, 3).otherwise(5)


def cost_key(road_class: Column, form: Column, lanes: Column, urban: Column) -> Column:
    """The cost table's key of a road or tunnel: by class, form of way, lanes, and urban or not."""
    c, place = clean_class(road_class), F.when(urban == 1, "urb").otherwise("sub")
    wide = lambda n: F.when(lanes >= n, f"ge{n}").otherwise(f"lt{n}")
    single = form == "Single Carriageway"
    out = F.when(c.isin("motorway", "motorway_link"), F.concat_ws("_", F.lit("m"), wide(8), place))
    out = out.when(c.isin("trunk", "primary", "secondary") & single, F.concat_ws("_", F.lit("asingle"), place))
    out = out.when(c.isin("trunk", "primary", "secondary"), F.concat_ws("_", F.lit("abdual"), wide(6), place))
    return out.when(single, F.concat_ws("_", F.lit("bsingle"), place)).otherwise(F.concat_ws("_", F.lit("bdual"), wide(6), place))


def fallback_key(road_class: Column) -> Column:
    out = F.lit("Local")
    for label, classes in FALLBACK_LABELS.items():
        out = F.when(clean_class(road_class).isin(*classes), label).otherwise(out)
    return out


#: How far roads lie above the ground, in the unit of the intensity, by flood; others as river.
EMBANKMENT = {"surface": 100.0, "river": 200.0}


def embanked(value: Column, hazard: str, road_class: Column, offset: float | None = None) -> Column:
    """The intensity on major roads less their embankment, 0 at least."""
    lower = EMBANKMENT.get(hazard, EMBANKMENT["river"]) if offset is None else offset
    return F.when(is_major(road_class), F.greatest(value - lower, F.lit(0.0))).otherwise(value)
