"""What a run is asked for: checks before anything is read, and what a run over an earlier run's folder takes over from it."""

from __future__ import annotations

from collections.abc import Callable

CROWNS, OUTLINES, MODES, POLICIES = ("watershed", "dalponte", "silva"), ("pixels", "simplified", "smooth"), ("canopy", "strict"), ("recent", "all")
#: What a run over a folder takes from it unless told otherwise.
INHERITED = ("buildings", "date", "mode", "policy", "context")


def one_of(**given: object) -> str:
    """The name of the one that is given; none or several are an error."""
    names = [k for k, v in given.items() if v is not None]
    if len(names) != 1:
        raise ValueError(f"give exactly one of {', '.join(given)}")
    return names[0]


def within(name: str, value: float, low: float, high: float) -> float:
    """low <= value < high; not-a-number is outside."""
    if not low <= value < high:
        raise ValueError(f"{name} must be at least {low:g} and below {high:g}")
    return value


def chosen(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


def heights(bbox: tuple[float, float, float, float] | None = None, geojson: str | None = None, recent: bool = False, dates: bool = True, max_km2: float = 2500.0, area_km2: float = 0.0) -> str:
    """Checks a run of heights: one source of the area, a box that is one, dates where recent, an area within bounds."""
    source = one_of(bbox=bbox, geojson=geojson)
    if bbox is not None and not (bbox[0] < bbox[2] and bbox[1] < bbox[3]):
        raise ValueError("a box is west, south, east, north")
    if recent and not dates:
        raise ValueError("recent needs image dates")
    if area_km2 > max_km2:
        raise ValueError(f"{area_km2:.0f} km2 is more than {max_km2:g}")
    return source


def buildings(mode: str = "canopy", policy: str = "recent", recent_years: int = 2, clearance_m: float = 2.0, max_stem_shift_m: float = 2.0) -> dict:
    if not isinstance(recent_years, int) or not 0 <= recent_years <= 10:
        raise ValueError("recent_years must be an integer from 0 to 10")
    return {"mode": chosen("mode", mode, MODES), "policy": chosen("policy", policy, POLICIES), "recent_years": recent_years, "clearance_m": within("clearance_m", clearance_m, 0, 100), "max_stem_shift_m": within("max_stem_shift_m", max_stem_shift_m, 0, 100)}


def inherited(report: dict, given: dict, out: str, folder: str, exists: Callable[[str], bool], checksum: Callable[[str], str]) -> dict:
    """The settings of a run over the folder of an earlier one: its tiles, each present and inside; its building settings where none are
    given, after the building file's checksum. Results must not go into the folder that is read."""
    if out.rstrip("/") == folder.rstrip("/"):
        raise ValueError("the results need a folder of their own")
    tiles = report.get("fine_files") or []
    if not tiles:
        raise ValueError("the folder's report names no tiles")
    for name in tiles:
        if "/" in name or name.startswith(".") or not exists(f"{folder.rstrip('/')}/{name}"):
            raise ValueError(f"{name} is missing, or not inside the folder")
    told = report.get("building_exclusion") or {}
    out_ = {k: given[k] if given.get(k) is not None else told.get(k) for k in INHERITED}
    if out_["buildings"] and given.get("buildings") is None and checksum(out_["buildings"]) != told.get("sha256"):
        raise ValueError("the building file changed since the earlier run")
    return {**given, **out_, "tiles": [f"{folder.rstrip('/')}/{n}" for n in tiles]}
