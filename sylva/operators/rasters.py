"""Focal operators over (r, c, h) tables. A pixel goes to the tile that holds it and, near a border, to those whose halo does; a tile
is one dense array, so each operator shuffles a pixel about once. Null heights are places without data; a pixel is in a table once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a raster that numbers its basins.
WIDEST = 100_000
#: Side of a tile in pixels.
TILE = 1024
#: North-west to south-east in row-major order.
AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def neighbours(px: DataFrame, offsets: list[tuple[int, int]] = AROUND) -> DataFrame:
    """r, c, h with each neighbour's nr, nc, nh and the offset's place k; only those that exist."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(offsets)])).alias("s")
    asked = px.select("r", "c", "h", steps).select("r", "c", "h", F.col("s.k").alias("k"), (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"))
    return asked.join(px.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("h").alias("nh")), ["nr", "nc"])


def focal(px: DataFrame, run: Callable, schema: str, halo: int = 1, tile: int = TILE, planes: tuple[str, ...] = ("h",)) -> DataFrame:
    """What run makes of each tile. run(there, *planes) gets dense arrays (not-a-number where there is no value), a frame of one place
    included, and gives the places that it tells (a mask) and their columns as arrays; those named to_r and to_c are places. A tile
    tells those of its own core alone."""
    near = lambda x: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda d: F.floor((F.col(x) + d) / tile).cast("int")))
    dealt = px.select("r", "c", *planes).withColumn("tile_r", F.explode(near("r"))).withColumn("tile_c", F.explode(near("c")))
    names = [x.split()[0] for x in schema.split(", ")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0 = int(r.min()) - 1, int(c.min()) - 1
        there = np.zeros((int(r.max()) - r0 + 2, int(c.max()) - c0 + 2), bool)
        there[r - r0, c - c0] = True
        held = []
        for name in planes:
            plane = np.full(there.shape, np.nan)
            plane[r - r0, c - c0] = pdf[name].astype(float)
            held.append(plane)
        keep, columns = run(there, *held)
        rows, cols = np.indices(there.shape)
        keep = keep & ((rows + r0) // tile == key[0]) & ((cols + c0) // tile == key[1])
        told = {"r": (rows + r0)[keep], "c": (cols + c0)[keep]}
        for name, array in columns.items():
            told[name] = array[keep] + (r0 if name == "to_r" else c0 if name == "to_c" else 0)
        out = pd.DataFrame({n: told[n] for n in names})
        return out.astype({n: "int64" for n in names if n in ("r", "c", "to_r", "to_c")})

    found = dealt.groupBy("tile_r", "tile_c").applyInPandas(one, schema)
    return found.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n, t in found.dtypes if t == "double"})


def beside(plane: np.ndarray, dr: int, dc: int, fill: float = np.nan) -> np.ndarray:
    """out[r, c] = plane[r + dr, c + dc]."""
    wide = np.pad(plane, max(abs(dr), abs(dc)), constant_values=fill)
    at = max(abs(dr), abs(dc))
    return wide[at + dr : at + dr + plane.shape[0], at + dc : at + dc + plane.shape[1]]


def mend(px: DataFrame, tile: int = TILE) -> DataFrame:
    """Pits (6 or more neighbours over 1.5 higher, the median too) take the median of their neighbours; so do places without a height,
    in the table or not, with 6 or more neighbours that have one."""

    def run(there: np.ndarray, h: np.ndarray) -> tuple:
        around = np.stack([beside(h, dr, dc) for dr, dc in AROUND])
        n = np.isfinite(around).sum(0)
        ranked = np.sort(around, 0)  # those without a value come last
        low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, 7)
        median = (np.take_along_axis(ranked, low[None], 0)[0] + np.take_along_axis(ranked, high[None], 0)[0]) / 2
        with np.errstate(invalid="ignore"):
            pit = ((around > h + 1.5).sum(0) >= 6) & (median - h > 1.5)
        new = pit | (np.isnan(h) & (n >= 6))
        return there | new, {"h": np.where(new, median, h)}

    return focal(px, run, "r int, c int, h double", tile=tile)


def steepest(px: DataFrame, tile: int = TILE) -> DataFrame:
    """The neighbour of greatest rise per distance, if above 0; ties to the first in order. Tops point at themselves."""

    def run(there: np.ndarray, h: np.ndarray) -> tuple:
        best, (to_r, to_c) = np.zeros(h.shape), np.indices(h.shape)
        for dr, dc in AROUND:
            with np.errstate(invalid="ignore"):
                rise = (beside(h, dr, dc) - h) / np.sqrt(float(dr * dr + dc * dc))
                more = rise > best
            best = np.where(more, rise, best)
            to_r, to_c = (np.where(more, at + d, to) for at, d, to in zip(np.indices(h.shape), (dr, dc), (to_r, to_c), strict=True))
        return there, {"h": h, "to_r": to_r, "to_c": to_c}

    return focal(px, run, "r int, c int, h double, to_r int, to_c int", tile=tile)


def climb(px: DataFrame, durable=lambda df: df, most: int = 32, tile: int = TILE) -> DataFrame:  # noqa: ANN001
    """Each pixel's root. Within a tile pointers are followed to the end, or to the first place outside; then by pointer jumping over
    the table, where the distance walked doubles every pass."""

    def run(there: np.ndarray, to_r: np.ndarray, to_c: np.ndarray) -> tuple:
        place = np.arange(there.size).reshape(there.shape)
        rows, cols = np.indices(there.shape)
        # Pointers are told as steps from the pixel, so that a tile need not know where it lies.
        to = np.where(there, (rows + np.nan_to_num(to_r).astype(int)) * there.shape[1] + cols + np.nan_to_num(to_c).astype(int), place).ravel()
        while not np.array_equal(to, to[to]):
            to = to[to]
        return there, {"to_r": to.reshape(there.shape) // there.shape[1], "to_c": to.reshape(there.shape) % there.shape[1]}

    steps = steepest(px, tile).select("r", "c", (F.col("to_r") - F.col("r")).alias("dr"), (F.col("to_c") - F.col("c")).alias("dc"))
    # No halo: a pointer out of the tile ends on the frame, whose place points at itself.
    to = durable(focal(steps, run, "r int, c int, to_r int, to_c int", 0, tile, ("dr", "dc")))
    for _ in range(most):
        nxt = to.select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), F.col("to_r").alias("n_r"), F.col("to_c").alias("n_c"))
        new = durable(to.join(nxt, ["to_r", "to_c"]).select("r", "c", F.col("n_r").alias("to_r"), F.col("n_c").alias("to_c"), ((F.col("n_r") != F.col("to_r")) | (F.col("n_c") != F.col("to_c"))).alias("moved")))
        to = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return to


def plateaus(roots: DataFrame, durable=lambda df: df) -> DataFrame:  # noqa: ANN001
    """roots (r, c, to_r, to_c) where tops that touch, and so are equally high, are one: its first pixel in row-major order."""
    from .regions import components

    tops = roots.select(F.col("to_r").alias("r"), F.col("to_c").alias("c")).distinct()
    named = components(tops, durable, corners=True).select(F.col("r").alias("to_r"), F.col("c").alias("to_c"), "root")
    return roots.join(named, ["to_r", "to_c"]).select("r", "c", F.col("root.r").alias("to_r"), F.col("root.c").alias("to_c"))


def passes(px: DataFrame, roots: DataFrame, tile: int = TILE) -> DataFrame:
    """Highest pass between each pair of touching basins: a, b (row * WIDEST + column of the root), saddle. A column beyond
    WIDEST is an error, since two roots would share a number."""
    widest = F.when(F.col("to_c").between(0, WIDEST - 1), F.col("to_c")).otherwise(F.raise_error(F.lit("a column outside 0 .. WIDEST - 1")).cast("long"))
    key = lambda r, c: (F.col(r).cast("long") * WIDEST + widest).alias("basin")
    named = roots.select("r", "c", key("to_r", "to_c"))
    named = px.join(roots.select("r", "c", key("to_r", "to_c")), ["r", "c"])

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        r0, c0 = int(r.min()), int(c.min())
        h, basin = np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan), np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), -1, np.int64)
        h[r - r0, c - c0], basin[r - r0, c - c0] = pdf["h"].astype(float), pdf["basin"]
        rows, cols = np.indices(h.shape)
        core = ((rows + r0) // tile == key_[0]) & ((cols + c0) // tile == key_[1])  # a pair belongs to the tile of its first pixel
        parts = []
        for dr, dc in [(0, 1), (1, -1), (1, 0), (1, 1)]:
            other = beside(basin, dr, dc, -1)
            low = np.minimum(h, beside(h, dr, dc))
            ok = core & (basin >= 0) & (other >= 0) & (basin != other) & np.isfinite(low)
            parts.append(pd.DataFrame({"a": np.minimum(basin, other)[ok], "b": np.maximum(basin, other)[ok], "saddle": low[ok]}))
        return pd.concat(parts).groupby(["a", "b"], as_index=False)["saddle"].max()

    near = lambda x: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(x) + d) / tile).cast("int")))
    dealt = named.select("r", "c", "h", "basin").withColumn("tile_r", F.explode(near("r"))).withColumn("tile_c", F.explode(near("c")))
    return dealt.groupBy("tile_r", "tile_c").applyInPandas(run, "a long, b long, saddle double").groupBy("a", "b").agg(F.max("saddle").alias("saddle"))


def window_tops(px: DataFrame, window: float = 3.0, share: float = 0.0, highest: float | None = None, tile: int = TILE) -> DataFrame:
    """Pixels that no pixel within max(window + share * h, 3) / 2 exceeds; equal ones are all tops. highest: the greatest
    height there is, read from the table where it is not told; it bounds the window."""
    if highest is None:
        highest = (px.agg(F.max("h")).first()[0] or 0.0) if share else 0.0
    radius = int(max(window + share * highest, 3.0) / 2)

    def run(there: np.ndarray, h: np.ndarray) -> tuple:
        with np.errstate(invalid="ignore"):
            reach, top = np.maximum(window + share * h, 3.0) / 2, there.copy()
            for dr in range(-radius, radius + 1):
                for dc in range(-radius, radius + 1):
                    if dr or dc:
                        top &= ~((dr * dr + dc * dc <= reach * reach) & (beside(h, dr, dc) > h))
        return top, {"h": h}

    return focal(px, run, "r int, c int, h double", radius, tile)


def gradient(px: DataFrame, smooth: float = 0.0, tile: int = TILE) -> DataFrame:
    """Slope in degrees by central differences, one-sided where a side is missing; with smooth, the differences are spread by a Gaussian
    of that deviation in pixels, weights renewed over the pixels there are."""

    def run(there: np.ndarray, h: np.ndarray) -> tuple:
        def across(dr: int, dc: int) -> np.ndarray:
            back, ahead = beside(h, -dr, -dc), beside(h, dr, dc)
            sides = np.isfinite(back).astype(int) + np.isfinite(ahead)
            return (np.where(np.isfinite(ahead), ahead, h) - np.where(np.isfinite(back), back, h)) / np.maximum(sides, 1)

        ways = [across(1, 0), across(0, 1)]
        if smooth:
            from .crowns import blurred

            ways = [np.where(np.isfinite(h), w, np.nan) for w in ways]
            ways = [blurred(np.nan_to_num(w), smooth) / np.maximum(blurred(np.isfinite(w).astype(float), smooth), 1e-9) for w in ways]
        return there, {"slope": np.where(np.isfinite(h), np.degrees(np.arctan(np.hypot(*ways))), np.nan)}

    return focal(px, run, "r int, c int, slope double", 1 + int(4 * smooth + 0.5), tile)


def bilinear(px: DataFrame, at: DataFrame) -> DataFrame:
    """h at fractional (y, x), from the 4 pixels around it, weights renewed over those that exist."""
    corners = F.explode(F.array(*[F.struct((F.floor("y") + a).cast("int").alias("r"), (F.floor("x") + b).cast("int").alias("c"), ((F.col("y") - F.floor("y")) if a else (1 - (F.col("y") - F.floor("y")))).alias("wy"), ((F.col("x") - F.floor("x")) if b else (1 - (F.col("x") - F.floor("x")))).alias("wx")) for a in (0, 1) for b in (0, 1)]))
    asked = at.select("id", corners.alias("k")).select("id", "k.r", "k.c", (F.col("k.wy") * F.col("k.wx")).alias("w"))
    return asked.join(px, ["r", "c"]).where("w > 0").groupBy("id").agg((F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("h"))


def spread_tops(points: DataFrame, pixel: float = 1.0, reach: float = 0.2) -> DataFrame:
    """Highest point of each pixel, each point standing also for 8 places at `reach` around it; ground and roof classes apart."""
    import math

    places = [(0.0, 0.0)] + [(reach * math.cos(k * math.pi / 4), reach * math.sin(k * math.pi / 4)) for k in range(8)]
    kept = points.where(~F.col("classification").isin(6, 7, 9, *range(13, 19)))
    out = kept.select("z", F.explode(F.array(*[F.struct(F.floor((F.col("y") + F.lit(b)) / pixel).cast("int").alias("r"), F.floor((F.col("x") + F.lit(a)) / pixel).cast("int").alias("c")) for a, b in places])).alias("p"))
    return out.groupBy("p.r", "p.c").agg(F.max("z").alias("h"))
