"""Grids and transverse Mercator as closed-form column expressions (Krueger's series to the third power of n)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and UTM.
AXIS, FLATTENING, SCALE, EASTING, SOUTHING = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
CELL_M = 10.0


def constants() -> tuple[float, float, list[float]]:
    """The meridian's radius, the eccentricity, and the three coefficients of the series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    return radius, 2 * math.sqrt(n) / (1 + n), series


def zone(west: Column, east: Column) -> Column:
    """UTM zone of a box's middle."""
    return F.floor(F.pmod((west + east) / 2 + 180, F.lit(360.0)) / 6).cast("int") + 1


def utm(lon: Column, lat: Column, zone_: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; below the equator with the southern offset."""
    radius, eccentricity, series = constants()
    away = F.radians(lon - (zone_ * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - eccentricity * F.atanh(eccentricity * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(series, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * radius * x, SCALE * radius * y + F.when(lat < 0, SOUTHING).otherwise(0.0)


def utm_sql(lon: str, lat: str, zone_: str) -> tuple[str, str]:
    """The same for DuckDB."""
    radius, eccentricity, series = constants()
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {eccentricity!r}*atanh({eccentricity!r}*{s}))"
    away = f"radians({lon} - ({zone_}*6 - 183))"
    xi, eta = f"atan2({t}, cos({away}))", f"atanh(sin({away})/sqrt(1 + pow({t}, 2)))"
    x = " + ".join([eta, *[f"{a!r}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, a in enumerate(series, 1)]])
    y = " + ".join([xi, *[f"{a!r}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, a in enumerate(series, 1)]])
    return f"({EASTING} + {SCALE * radius!r}*({x}))", f"({SCALE * radius!r}*({y}) + CASE WHEN {lat} < 0 THEN {SOUTHING} ELSE 0 END)"


def box_edge_points(points: int = 21) -> list[tuple[float, float]]:
    """Shares along the width and the height of a box's outline, with so many points between two corners."""
    steps = [k / (points + 1) for k in range(points + 2)]
    return sorted({(t, s) for t in steps for s in (0.0, 1.0)} | {(s, t) for t in steps for s in (0.0, 1.0)})


def snapped(xmin: Column, ymin: Column, xmax: Column, ymax: Column, cell: float = CELL_M) -> dict[str, Column]:
    """left, top on multiples of the cell, width and height in cells, which cover the box."""
    left, top = F.floor(xmin / cell) * cell, F.ceil(ymax / cell) * cell
    return {"left": left.cast("double"), "top": top.cast("double"), "height": F.ceil((top - ymin) / cell).cast("int"), "width": F.ceil((xmax - left) / cell).cast("int")}


def to_cell(x: Column, y: Column, west: float, north: float, pixel: float, rows: int, cols: int) -> tuple[Column, Column, Column]:
    """Row, column and whether they lie on a north-up grid."""
    r, c = F.floor((F.lit(north) - y) / pixel).cast("int"), F.floor((x - west) / pixel).cast("int")
    return r, c, (r >= 0) & (r < rows) & (c >= 0) & (c < cols)


def affine(col: Column, row: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    """x and y of fractional pixels under a grid without shear."""
    return c + col * a, f + row * e


def inverse(x: Column, y: Column, a: float, c: float, e: float, f: float) -> tuple[Column, Column]:
    """Fractional column and row."""
    return (x - c) / a, (y - f) / e
