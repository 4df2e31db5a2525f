"""Map projections as column expressions: degrees to metres and back, and names of coordinate systems that mean the same."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the latitude's iteration, which settles to the last digits in four.
STEPS = 6


@dataclass(frozen=True)
class Albers:
    """Conic, equal areas, on an ellipsoid: first and second standard parallel and origin in degrees."""

    first: float
    second: float
    latitude: float
    longitude: float
    radius: float = 6378137.0
    flattening: float = 1 / 298.257222101

    def _constants(self) -> tuple[float, float, float, float]:
        e2 = self.flattening * (2 - self.flattening)
        e = math.sqrt(e2)

        def q(degrees: float) -> float:
            s = math.sin(math.radians(degrees))
            return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

        def m(degrees: float) -> float:
            s = math.sin(math.radians(degrees))
            return math.cos(math.radians(degrees)) / math.sqrt(1 - e2 * s * s)

        n = (m(self.first) ** 2 - m(self.second) ** 2) / (q(self.second) - q(self.first)) if self.first != self.second else math.sin(math.radians(self.first))
        c = m(self.first) ** 2 + n * q(self.first)
        return e, n, c, self.radius * math.sqrt(c - n * q(self.latitude)) / n

    def _q(self, sine: Column) -> Column:
        e = self._constants()[0]
        return (1 - e * e) * (sine / (1 - e * e * sine * sine) - F.log((1 - e * sine) / (1 + e * sine)) / (2 * e))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        _, n, c, origin = self._constants()
        rho = self.radius * F.sqrt(c - n * self._q(F.sin(F.radians(lat)))) / n
        theta = n * F.radians(_turn(lon - self.longitude))
        return rho * F.sin(theta), origin - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e, n, c, origin = self._constants()
        sign = math.copysign(1.0, n)
        theta = F.atan2(sign * x, sign * (origin - y))
        rho = F.sqrt(x * x + (origin - y) * (origin - y))
        q = (c - (rho * n / self.radius) * (rho * n / self.radius)) / n

        def better(phi: Column, q: Column) -> Column:
            s, e2 = F.sin(phi), e * e
            w = 1 - e2 * s * s
            return phi + w * w / (2 * F.cos(phi)) * (q / (1 - e2) - s / w + F.log((1 - e * s) / (1 + e * s)) / (2 * e))

        # Lambdas bind q and each step's latitude, or their expressions would double at every use.
        phi = F.get(F.transform(F.array(q), lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.asin(F.greatest(F.least(v / 2, F.lit(1.0)), F.lit(-1.0))), lambda p, _: better(p, v))), F.lit(0))
        return _turn(self.longitude + F.degrees(theta) / n), F.degrees(phi)


@dataclass(frozen=True)
class Azimuthal:
    """Azimuthal, equal areas, on a sphere."""

    latitude: float
    longitude: float
    radius: float = 6370997.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        s0, c0 = math.sin(math.radians(self.latitude)), math.cos(math.radians(self.latitude))
        turn, phi = F.radians(lon - self.longitude), F.radians(lat)
        k = self.radius * F.sqrt(2 / (1 + s0 * F.sin(phi) + c0 * F.cos(phi) * F.cos(turn)))
        return k * F.cos(phi) * F.sin(turn), k * (c0 * F.sin(phi) - s0 * F.cos(phi) * F.cos(turn))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        s0, c0 = math.sin(math.radians(self.latitude)), math.cos(math.radians(self.latitude))
        rho = F.sqrt(x * x + y * y)
        c = 2 * F.asin(F.least(rho / (2 * self.radius), F.lit(1.0)))
        phi = F.asin(F.cos(c) * s0 + F.when(rho > 0, y * F.sin(c) * c0 / rho).otherwise(0.0))
        return _turn(self.longitude + F.degrees(F.atan2(x * F.sin(c), rho * c0 * F.cos(c) - y * s0 * F.sin(c)))), F.degrees(phi)


@dataclass(frozen=True)
class Mercator:
    """The web's Mercator: on a sphere, to 85.06 degrees; beyond lie no finite or no useful metres."""

    radius: float = 6378137.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self.radius * F.radians(lon), self.radius * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / self.radius), F.degrees(2 * F.atan(F.exp(y / self.radius)) - math.pi / 2)


@dataclass(frozen=True)
class Degrees:
    """Longitude and latitude as they are."""

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


def _turn(degrees: Column) -> Column:
    """Degrees from -180 up to 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


#: Coordinate systems by their published codes.
SYSTEMS = {
    "EPSG:4326": Degrees(),
    "EPSG:3857": Mercator(),
    "EPSG:2163": Azimuthal(45.0, -100.0),
    "EPSG:5070": Albers(29.5, 45.5, 23.0, -96.0),
}
#: Other names, in capitals and without blanks. The last three are taken for the national atlas' system, as callers expect.
ALIASES = {
    "WGS84": "EPSG:4326", "OGC:CRS84": "EPSG:4326", "EPSG:900913": "EPSG:3857", "USNATIONALATLASEQUALAREA": "EPSG:2163", "ESRI:102008": "EPSG:2163", "102008": "EPSG:2163",
}


def canonical(name: str | int | None) -> str:
    """The code of a system by any of its names; none is the national atlas'. Names that are not known come back in capitals."""
    if name is None:
        return "EPSG:2163"
    text = "".join(str(name).upper().split())
    text = f"EPSG:{text}" if f"EPSG:{text}" in SYSTEMS else text
    return next((code for alias, code in ALIASES.items() if alias == text or not alias.isdigit() and len(alias) > 10 and alias in text), text)


def equivalent(a: str | int | None, b: str | int | None) -> bool:
    """Whether two names mean one system; none is like none only."""
    return a is b if a is None or b is None else canonical(a) == canonical(b)


def transform(x: Column, y: Column, source: str | int, target: str | int) -> tuple[Column, Column]:
    """Coordinates of one system in another, by way of degrees (datums are taken as one). Systems not in SYSTEMS raise KeyError; null gives null."""
    a, b = canonical(source), canonical(target)
    if a not in SYSTEMS or b not in SYSTEMS:
        raise KeyError(f"no projection between {a} and {b}; there are {', '.join(SYSTEMS)}")
    return (x, y) if a == b else SYSTEMS[b].forward(*SYSTEMS[a].inverse(x, y))


def transform_vertices(vertices: Column, source: str | int, target: str | int) -> Column:
    """A line's vertices in another system."""

    def one(p: Column) -> Column:
        x, y = transform(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(vertices, one)
