"""Speeds, capacities and generalised costs of links, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversions, values of time ($/h), fuel prices ($/l), fuel and other operating cost curves.
METRE_TO_MILE, MILE_TO_KM, EPSILON, OCCUPANCY = 0.000621371, 1.60934, 1e-6, 1.06
VALUE_OF_TIME = {"car": 18.50, "lgv": 31.00, "ogv": 32.50, "psv": 18.50, "rail": 22.90}
FUEL_PRICE = {"car": 0.90, "lgv": 0.90, "ogv": 1.04, "psv": 1.04, "rail": 1.04}
FUEL_CURVE = {"car": (0.75232, 0.05130, 0.00057, 0.000000372), "lgv": (0.65074, 0.09512, -0.00301, 0.000020), "ogv": (6.73854, 0.13573, -0.00191, 0.000014), "psv": (5.41589, 0.18347, -0.00206, 0.000015)}
OTHER_CURVE = {"car": (8.74, 239.77), "lgv": (12.70, 83.06), "ogv": (17.41, 680.18), "psv": (53.67, 1223.40)}
# Fixed values by tier: vehicles a lane and hour, break point, free flow, urban cap, least speed (mph), congestion factor.
TIERS = {"freeway": (2400, 1400, 70, 55, 10, 0.033), "arterial": (2200, 1300, 60, 45, 8, 0.033), "collector": (1700, 1100, 55, 35, 7, 0.05), "local_access": (1000, 800, 35, 30, 5, 0.05)}
# Tiers by road class; the classes that count as major.
CLASS_TO_TIER = {
    "motorway": "freeway", "motorway_link": "freeway", "trunk": "freeway", "primary": "arterial", "secondary": "arterial", "tertiary": "collector",
    "local": "arterial", "service": "local_access", "unclassified": "local_access", "centroid_connector": "local_access",
}
MAJOR_CLASSES = ("motorway", "motorway_link", "trunk", "primary", "secondary")


def clean_class(road_class: Column) -> Column:
    """Lower case, trimmed; null is empty."""
    return F.lower(F.trim(F.coalesce(road_class.cast("string"), F.lit(""))))


def is_major(road_class: Column, *more: str) -> Column:
    return clean_class(road_class).isin(*MAJOR_CLASSES, *more)


def tier(road_class: Column) -> Column:
    """The tier of a road class; null-like classes are unclassified, unknown ones arterial."""
    c = F.lower(F.trim(road_class))
    c = F.when(c.isNull() | c.isin("", "nan", "none", "null"), "unclassified").otherwise(c)
    out = F.lit("arterial")
    for name, t in CLASS_TO_TIER.items():
        out = F.when(c == name, t).otherwise(out)
    return out


def tier_value(tier_col: Column, which: int) -> Column:
    """A tier's value by its place in TIERS, arterial's for others."""
    out = F.lit(float(TIERS["arterial"][which]))
    for name, values in TIERS.items():
        out = F.when(tier_col == name, F.lit(float(values[which]))).otherwise(out)
    return out


def operating_cost(miles: Column, hours: Column, vehicle: str) -> tuple[Column, Column]:
    """(time cost, operating cost) of a link; buses and trains have no operating cost; other vehicles raise ValueError."""
    if vehicle not in VALUE_OF_TIME:
        raise ValueError(f"unknown vehicle {vehicle}")
    time = hours * F.lit(VALUE_OF_TIME[vehicle]) * F.lit(OCCUPANCY if vehicle == "car" else 1.0)
    if vehicle in ("psv", "rail"):
        return time, F.lit(0.0)
    km = miles * F.lit(MILE_TO_KM)
    v = km / F.greatest(hours, F.lit(EPSILON))
    a, b, c, d = FUEL_CURVE[vehicle]
    a1, b1 = OTHER_CURVE[vehicle]
    slow = F.greatest(v, F.lit(EPSILON))
    fuel = (F.lit(a) / slow + F.lit(b) + F.lit(c) * v + F.lit(d) * v * v) * F.lit(FUEL_PRICE[vehicle])
    return time, (fuel + (F.lit(a1) + F.lit(b1) / slow) / 100) * km


def link_cost(metres: Column, mph: Column, toll: Column, vehicle: str = "car") -> Column:
    """Time, operation and toll of a link; null where it has no speed."""
    miles = metres * F.lit(METRE_TO_MILE)
    time, operate = operating_cost(miles, F.try_divide(miles, mph), vehicle)
    return time + operate + toll


def congestion_speed(flow: Column, initial: Column, factor: Column, breakpoint: Column, least: Column) -> Column:
    """The initial speed less what hourly flow beyond the break point costs, not below ``least``."""
    return F.greatest(initial - factor * F.greatest(flow / 24 - breakpoint, F.lit(0.0)), least)


def free_flow(own: Column, candidates: list[Column], tier_col: Column, urban: Column) -> Column:
    """The link's own speed, else the first positive candidate, else its tier's; urban links keep their tier's cap."""
    positive = [F.when(c > 0, c) for c in candidates]
    base = F.coalesce(own, *positive, tier_value(tier_col, 2))
    return F.when(urban > 0, F.least(base, tier_value(tier_col, 3))).otherwise(base)


def fares(km: Column) -> tuple[Column, Column]:
    """(bus, rail) fares by distance, capped."""
    return F.least(2 + 0.15 * km, F.lit(4.5)), F.least(3 + 0.2 * km, F.lit(250.0))


#: Hours of waiting that a trip by bus or rail adds.
WAITING = {"psv": 0.25, "rail": 0.15}


def waiting_cost(vehicle: str) -> float:
    """What waiting adds to the time cost of a trip."""
    return WAITING.get(vehicle, 0.0) * VALUE_OF_TIME[vehicle]


def speed_override(free: Column, least: Column, cap: Column) -> Column:
    """Free-flow speed under a cap: 0 where the cap is below the least speed (such links go), the cap where it is below the free speed."""
    return F.when(cap.isNull(), free).when(cap < least, F.lit(0.0)).when(cap < free, cap).otherwise(free)


def bpr_time(t0: Column, flow: Column, capacity: Column, alpha: float = 0.15, beta: float = 4.0) -> Column:
    """Travel time at a flow; free time where there is no capacity or no flow."""
    return F.when((capacity <= 0) | (flow <= 0), t0).otherwise(t0 * (1 + alpha * F.pow(F.try_divide(flow, capacity), F.lit(beta))))


def haversine_miles(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 3958.7613) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
