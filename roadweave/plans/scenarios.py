"""Hazard events: a manifest's rows first, then the built-in keys."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from ..sources.settings import setting

#: Scenario keys, their hazard and closure threshold.
BUILT_IN = {301: ("flood", 30.0), 302: ("flood", 30.0), 303: ("flood", 30.0), 401: ("earthquake", 25.0), 501: ("landslide", 100.0), 601: ("winter_storm", 100.0), 701: ("snow", 150.0), 30: ("flood", 30.0), 150: ("snow", 150.0)}


@dataclass(frozen=True)
class Scenario:
    hazard: str
    subtype: str
    event_id: str
    key: int
    threshold: float
    source: str = ""
    label: str = ""


def read_manifest(text: str) -> list[Scenario]:
    """The events of a JSON manifest, an object with events or a bare list; one without hazard_type or scenario_param raises ValueError."""
    out = []
    rows = json.loads(text)
    for e in rows.get("events", []) if isinstance(rows, dict) else rows:
        if "hazard_type" not in e or "scenario_param" not in e:
            raise ValueError(f"an event needs hazard_type and scenario_param: {e}")
        key = int(e["scenario_param"])
        threshold = e.get("closure_threshold", BUILT_IN.get(key, ("", 30.0))[1])
        out.append(Scenario(e["hazard_type"], e.get("hazard_subtype", ""), str(e.get("event_id", "1")), key, float(threshold), e.get("source", ""), e.get("label", "")))
    return out


def resolve(key: int, event_id: str = "1", manifest: list[Scenario] | None = None) -> Scenario:
    """The manifest's event of that key and id, else of that key; else the built-in one; other keys raise KeyError."""
    of_key = [s for s in manifest or [] if s.key == key]
    for s in of_key:
        if s.event_id == str(event_id):
            return s
    if of_key:
        return of_key[0]
    hazard, threshold = BUILT_IN[key]
    return Scenario(hazard, "", str(event_id), key, threshold)


#: Names in the environment that choose a scenario, the first that has a value; callers may pass their own.
NAMES = {"param": ("ROADWEAVE_SCENARIO_PARAM",), "hazard": ("ROADWEAVE_HAZARD_TYPE",), "subtype": ("ROADWEAVE_FLOOD_SUBTYPE",)}


def registered(manifest: list[Scenario] | None = None) -> Iterator[Scenario]:
    """A manifest's scenarios alone if there is one, else the built-in ones; the first of each key."""
    seen: set[int] = set()
    for s in manifest if manifest is not None else [Scenario(h, "", "1", k, t) for k, (h, t) in BUILT_IN.items()]:
        if s.key not in seen:
            seen.add(s.key)
            yield s


def by_param(key: int, manifest: list[Scenario] | None = None) -> Scenario | None:
    return next((s for s in registered(manifest) if s.key == int(key)), None)


def by_environment(environment: dict[str, str], manifest: list[Scenario] | None = None, event_id: str | None = None, names: dict[str, tuple[str, ...]] = NAMES) -> Scenario | None:
    """The first scenario of the environment's hazard (flood unless set) and, for floods, its subtype if that is set."""
    hazard = setting(names["hazard"], "flood", environment).lower()
    subtype = setting(names["subtype"], None, environment) if hazard == "flood" else None
    fits = (s for s in registered(manifest) if s.hazard == hazard and (subtype is None or s.subtype == subtype) and (event_id is None or s.event_id == str(event_id)))
    return next(fits, None)


def active(key: int | None = None, event_id: str = "1", threshold: float | None = None, manifest: list[Scenario] | None = None, environment: dict[str, str] | None = None, names: dict[str, tuple[str, ...]] = NAMES) -> Scenario:
    """The scenario that a run uses, by the first rule that finds one; the event id is always the caller's.

    1. The environment's key, which goes before the caller's ``key``, among the registered scenarios. 2. The environment's
    hazard, with that key if there is one. 3. The older rule: the key is the closure threshold too, of the environment's
    hazard. A ``threshold`` that is given wins everywhere; with neither key nor scenario ValueError is raised.
    """
    env = environment or {}
    if text := setting(names["param"], None, env):
        key = int(text)
    found = by_param(key, manifest) if key is not None else None
    if found is None and (found := by_environment(env, manifest, event_id, names)) and key is not None:
        found = replace(found, key=int(key))
    if found is None and key is None:
        raise ValueError("no scenario: give a key, or a hazard that is registered")
    if found is None:
        hazard = setting(names["hazard"], "flood", env).lower()
        found = Scenario(hazard, setting(names["subtype"], "", env) if hazard == "flood" else "", str(event_id), int(key), float(key))
    return replace(found, event_id=str(event_id), threshold=found.threshold if threshold is None else float(threshold))
