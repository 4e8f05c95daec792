"""Polygons as columns: rings are arrays of arrays of (x, y), closed without repeating the first corner, holes and parts alike
(even-odd rule). Predicates work on the list of edges, inside generated code; joins bring only near candidates to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def edges(rings: Column) -> Column:
    """array of (x0, y0, x1, y1); a null or empty ring has none."""
    of = lambda ring: F.transform(ring, lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), F.get(ring, (i + 1) % F.size(ring))["x"].alias("x1"), F.get(ring, (i + 1) % F.size(ring))["y"].alias("y1")))
    return F.flatten(F.transform(rings, of))


def box(rings: Column) -> Column:
    """xmin, ymin, xmax, ymax of all corners; null without corners."""
    xs, ys = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def crossings(sides: Column, x: Column, y: Column) -> Column:
    """How many edges a ray from (x, y) towards greater x crosses."""
    crossed = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & (x < e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)))
    return F.size(F.filter(sides, crossed))


def on_edge(sides: Column, x: Column, y: Column) -> Column:
    on = lambda e: ((e["x1"] - e["x0"]) * (y - e["y0"]) == (e["y1"] - e["y0"]) * (x - e["x0"])) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))
    return F.exists(sides, on)


def contains(sides: Column, x: Column, y: Column) -> Column:
    """Even-odd; of points on an edge those towards greater x and y of it lie outside."""
    return crossings(sides, x, y) % 2 == 1


def covers(sides: Column, x: Column, y: Column) -> Column:
    """Inside or on an edge."""
    return on_edge(sides, x, y) | contains(sides, x, y)


def meets_square(sides: Column, x: Column, y: Column, size: Column) -> Column:
    """Whether the polygon meets the inside of the square from (x, y) on: an edge passes through, or its middle lies inside.

    An edge is cut to the open square: the largest of its entries must come before the least of its exits."""

    def passes(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        part = lambda d, start, low: (F.when(d != 0, F.least((low - start) / d, (low + size - start) / d)).otherwise(F.when((start > low) & (start < low + size), F.lit(0.0)).otherwise(F.lit(2.0))), F.when(d != 0, F.greatest((low - start) / d, (low + size - start) / d)).otherwise(F.lit(1.0)))
        (in_x, out_x), (in_y, out_y) = part(dx, e["x0"], x), part(dy, e["y0"], y)
        return F.greatest(in_x, in_y, F.lit(0.0)) < F.least(out_x, out_y, F.lit(1.0))

    return F.exists(sides, passes) | contains(sides, x + size / 2, y + size / 2)


def area(sides: Column) -> Column:
    """Of rings that run one way around, holes the other way."""
    return F.abs(F.aggregate(sides, F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"])) / 2


def cornered(ring: Column) -> Column:
    """One pass of cutting the corners: each edge gives its points at a quarter and at three quarters."""
    at = lambda p, q, t: F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
    return F.flatten(F.transform(ring, lambda p, i: F.array(at(p, F.get(ring, (i + 1) % F.size(ring)), 0.25), at(p, F.get(ring, (i + 1) % F.size(ring)), 0.75))))


def rounded(rings: Column, passes: int = 2) -> Column:
    """All rings with their corners cut; rings of fewer than three corners stay."""
    for _ in range(passes):
        rings = F.transform(rings, lambda ring: F.when(F.size(ring) >= 3, cornered(ring)).otherwise(ring))
    return rings
