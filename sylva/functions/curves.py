"""Piecewise-linear curves as column expressions: compiled to CASE, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published pooled v1 curves (knot, value).
META = [(0.0, 1.93), (1.0, 5.67), (2.0, 6.68), (3.5, 7.81), (5.99, 9.39), (8.5, 11.13), (11.87, 14.061), (16.79, 19.29), (21.92, 33.025), (26.84, 38.377), (33.56, 41.786)]
ETH = [(0.17, 0.92), (1.38, 0.96), (2.43, 1.055), (3.95, 1.11), (6.27, 1.53), (8.92, 3.177), (12.29, 7.23), (17.03, 12.329), (21.97, 17.71), (27.32, 27.417), (37.83, 39.45)]
MATCHED = [(0.0, 1.611), (1.0, 4.78), (2.0, 5.821), (3.5, 7.132), (5.99, 9.281), (8.5, 11.682), (11.87, 15.524), (16.79, 23.077), (21.92, 34.233), (26.84, 41.812), (33.56, 50.77)]
WEIGHT = [(1.56, 0.0), (2.48, 1.0), (4.03, 0.8), (6.31, 0.75), (8.72, 0.6), (12.21, 0.5), (17.15, 0.4), (22.38, 0.25), (27.49, 0.15), (37.51, 0.25)]
#: Lower edges of the height bands (m) and the published expected absolute error of each.
BANDS = [0, 2, 5, 8, 12, 16, 20, 25, 35]
ERRORS = [1.3, 3.5, 3.2, 3.4, 3.6, 4.2, 4.4, 5.2, 7.5]


def lookup(x: Column, curve: list[tuple[float, float]], extend: bool = True) -> Column:
    """Linear between knots, flat below the first; above the last y + (x - last) or, if not extend, flat. Null stays null."""
    last_x, last_y = curve[-1]
    out = F.when(x >= last_x, F.lit(last_y) + (x - last_x) if extend else F.lit(last_y)).when(x <= curve[0][0], F.lit(curve[0][1]))
    for (x0, y0), (x1, y1) in zip(curve, curve[1:], strict=False):
        out = out.when(x < x1, F.lit(y0) + (x - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return out


def lookup_sql(x: str, curve: list[tuple[float, float]], extend: bool = True) -> str:
    """The same for DuckDB."""
    last_x, last_y = curve[-1]
    parts = [f"WHEN {x} >= {last_x}e0 THEN {last_y}e0" + (f" + ({x} - {last_x}e0)" if extend else ""), f"WHEN {x} <= {curve[0][0]}e0 THEN {curve[0][1]}e0"]
    parts += [f"WHEN {x} < {x1}e0 THEN {y0}e0 + ({x} - {x0}e0) * {(y1 - y0) / (x1 - x0)!r}e0" for (x0, y0), (x1, y1) in zip(curve, curve[1:], strict=False)]
    return f"(CASE {' '.join(parts)} END)"


def band(x: Column) -> Column:
    """The lower edge of x's height band: the largest edge at or below x, the first for anything lower."""
    out = F.lit(BANDS[0])
    for edge in BANDS[1:]:
        out = F.when(x >= edge, F.lit(edge)).otherwise(out)
    return F.when(x.isNotNull(), out)


def band_sql(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} >= {e} THEN {e}" for e in reversed(BANDS[1:])) + f" WHEN {x} IS NOT NULL THEN 0 END)"
