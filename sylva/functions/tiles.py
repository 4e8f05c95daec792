"""Tile names, quadkeys, projections' small arithmetic, and text helpers, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def slippy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Tile column and row, clamped to the grid."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    return clamp(x), clamp(y)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Interleaved bits as base-4 digits, the highest first."""
    digit = lambda i: F.call_function("shiftright", x, i).bitwiseAND(F.lit(1)) + 2 * F.call_function("shiftright", y, i).bitwiseAND(F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(zoom - 1), F.lit(0)), lambda i: digit(i).cast("string")), "")


def degree_tile(lon: Column, lat: Column, step: int) -> Column:
    """Name of a tile by its south-west corner, as N03E006."""
    return tile_name(F.floor(lat / step) * step, F.floor(lon / step) * step)


def tile_name(south: Column, west: Column) -> Column:
    return F.concat(F.when(south < 0, "S").otherwise("N"), F.lpad(F.abs(south).cast("string"), 2, "0"), F.when(west < 0, "W").otherwise("E"), F.lpad(F.abs(west).cast("string"), 3, "0"))


def degree_tiles(west: Column, south: Column, east: Column, north: Column, step: int, closed: bool = False) -> Column:
    """Names of the tiles over a box, by rows from the south. A box that only touches a tile's lower edge from below does not reach
    it, unless closed: then the tiles of both far corners count."""

    def starts(low: Column, high: Column) -> Column:
        first = (F.floor(low / step) * step).cast("int")
        last = (F.floor(high / step) * step if closed else F.ceil(high / step) * step - step).cast("int")
        return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(starts(south, north), lambda s: F.transform(starts(west, east), lambda w: tile_name(s, w))))


def quadkeys(west: Column, south: Column, east: Column, north: Column, zoom: int) -> Column:
    """Quadkeys of the tiles over a box, by rows from the north."""
    (x0, y1), (x1, y0) = slippy(west, south, zoom), slippy(east, north, zoom)
    span = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(span(y0, y1), lambda y: F.transform(span(x0, x1), lambda x: quadkey(x, y, zoom))))


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere of radius 6,371,008.8 m."""
    s = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    return 2 * 6_371_008.8 * F.asin(F.sqrt(s(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s(lon2 - lon1)))


def flag_name(v: Column, names: list[str]) -> Column:
    """Names of the set bits joined by ' + ', else none."""
    parts = F.filter(F.array(*[F.when(v.bitwiseAND(F.lit(1 << i)) > 0, n) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, " + ")).otherwise("none")


def pixel_for(density: Column) -> Column:
    return F.when(density >= 40, 0.25).when(density >= 6, 0.5).otherwise(1.0)
