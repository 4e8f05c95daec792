"""Checks of what is asked for, and what is taken over from an earlier run."""

import pytest

from sylva.plans import arguments as A


def test_checks():
    assert A.heights(bbox=(0, 0, 1, 1)) == "bbox" and A.heights(geojson="x") == "geojson"
    for bad in ({}, {"bbox": (0, 0, 1, 1), "geojson": "x"}, {"bbox": (1, 0, 0, 1)}, {"geojson": "x", "recent": True, "dates": False}, {"geojson": "x", "area_km2": 2501}):
        with pytest.raises(ValueError):
            A.heights(**bad)
    assert A.buildings()["mode"] == "canopy"
    for bad in ({"mode": "both"}, {"recent_years": 11}, {"recent_years": 1.5}, {"clearance_m": float("nan")}, {"max_stem_shift_m": 100}):
        with pytest.raises(ValueError):
            A.buildings(**bad)


def test_inherited():
    report = {"fine_files": ["a.tif", "b.tif"], "building_exclusion": {"buildings": "b.geojson", "date": "2020", "mode": "strict", "sha256": "1"}}
    go = lambda given=(), exists=lambda p: True, checksum=lambda p: "1", out="/out": A.inherited(report, dict(given), out, "/run/", exists, checksum)
    got = go()
    assert got["tiles"] == ["/run/a.tif", "/run/b.tif"] and (got["mode"], got["date"], got["policy"]) == ("strict", "2020", None)
    assert go({"mode": "canopy", "buildings": "own"}, checksum=lambda p: "2")["mode"] == "canopy"
    for bad in ({"checksum": lambda p: "2"}, {"exists": lambda p: "b" not in p}, {"out": "/run"}):
        with pytest.raises(ValueError):
            go(**bad)
    with pytest.raises(ValueError, match="no tiles"):
        A.inherited({}, {}, "/out", "/run", lambda p: True, lambda p: "1")
