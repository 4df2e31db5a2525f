"""Parameters and places, read on the driver: JSON bundles, registries, the first path there is, hazard files of events."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from pathlib import Path
from typing import Any


def first_existing(paths: Iterable[str | os.PathLike]) -> str | None:
    """The first of the paths that is there."""
    return next((str(p) for p in paths if p and Path(p).exists()), None)


def setting(names: Iterable[str], default: str | None = None, environment: dict[str, str] | None = None) -> str | None:
    """The first of the environment's names that has a value."""
    env = os.environ if environment is None else environment
    return next((env[n].strip() for n in names if env.get(n, "").strip()), default)


def load_profiles(folder: str, name: str = "assignment_profiles.json", legacy: dict[str, str] | None = None) -> dict[str, dict[str, float]]:
    """Parameter sets by profile: of one bundle {profile: {name: value}}, else of a file each ({parameter: file of {profile: value}}).

    Values become numbers, profile names lose blanks and case; a folder with neither raises FileNotFoundError.
    """
    bundle = Path(folder) / name
    if bundle.exists():
        return {str(k).strip().lower(): {n: float(v) for n, v in values.items()} for k, values in json.loads(bundle.read_text()).items()}
    out: dict[str, dict[str, float]] = {}
    for parameter, file in (legacy or {}).items():
        if (path := Path(folder) / file).exists():
            for k, v in json.loads(path.read_text()).items():
                out.setdefault(str(k).strip().lower(), {})[parameter] = float(v)
    if not out:
        raise FileNotFoundError(f"no profiles in {folder}")
    return out


def load_mapping(folder: str, source: str) -> dict[str, Any]:
    """A network source's map of classes to tiers, from network_mapping.<source>.json."""
    return json.loads((Path(folder) / f"network_mapping.{source.strip().lower()}.json").read_text())


def testbeds(folder: str) -> list[str]:
    """Ids of the testbeds that a folder holds, one JSON file each."""
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def load_testbed(folder: str, name: str) -> dict[str, Any]:
    path = Path(folder) / f"{name}.json"
    if not path.exists():
        raise KeyError(f"no testbed {name}; there are {', '.join(testbeds(folder))}")
    return {"id": name, **json.loads(path.read_text())}


def event_keys(text: str, known: Iterable[int]) -> list[int]:
    """all, or numbers with commas; others than the known ones raise ValueError."""
    known = sorted(known)
    if text.strip().lower() == "all":
        return known
    try:
        wanted = [int(p) for p in text.split(",") if p.strip()]
    except ValueError as e:
        raise ValueError(f"events are all or numbers with commas, not {text!r}") from e
    if wrong := [k for k in wanted if k not in known]:
        raise ValueError(f"no events {wrong}; there are {known}")
    return wanted


def event_of_path(path: str) -> str:
    """The event that a raster belongs to: the folder two above it, else the first number of three digits or more of its name, else the first number, else what stands before the first _."""
    parts = Path(path).parts
    if len(parts) >= 3 and parts[-3] not in ("surface", "river", "both", "Raster"):
        return parts[-3]
    numbers = re.findall(r"[0-9]+", Path(path).stem)
    return next((n for n in numbers if len(n) >= 3), numbers[0] if numbers else Path(path).stem.split("_")[0])


def flood_files(root: str) -> dict[str, dict[str, list[str]]]:
    """Rasters by event and type of flood, in root/{surface,river,both}/**/Raster/**/*.tif.

    Names need RD and may not have IE; in both, FLSW is surface and FLRF river.
    """
    out: dict[str, dict[str, list[str]]] = {}
    for folder in ("surface", "river", "both"):
        for p in sorted((Path(root) / folder).glob("**/Raster/**/*.tif")):
            if "RD" not in p.name or "IE" in p.name:
                continue
            kind = folder if folder != "both" else "surface" if "FLSW" in p.name else "river" if "FLRF" in p.name else None
            if kind:
                out.setdefault(event_of_path(str(p)), {}).setdefault(kind, []).append(str(p))
    return out


def hazard_files(root: str, hazard: str) -> dict[str, dict[str, list[str]]]:
    """Rasters by event below a folder: the event is the folder's name if that is a number, else the file's."""
    out: dict[str, dict[str, list[str]]] = {}
    for p in sorted(Path(root).rglob("*.tif")):
        event = p.parent.name if p.parent.name.isdigit() else p.stem
        out.setdefault(event, {}).setdefault(hazard, []).append(str(p))
    return out
