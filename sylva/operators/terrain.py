"""The ground under every pixel, from the means of ground points: blocks with a margin, each one dense array.

Where cells without ground points lie between others the ground is interpolated along the row and along the column, each linearly
between the nearest known cells, and the two are weighed by how near these are; beyond the known ones it is the nearest known
cell's. That stands for a triangulation of the cells: on a plane both give the plane.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crowns import nearest_known

BLOCK, MARGIN = 512, 48


def along(mean: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear between the known cells of each row, and the span between these (infinite outside them)."""
    c = np.broadcast_to(np.arange(mean.shape[1]), mean.shape)
    left = np.maximum.accumulate(np.where(known, c, -1), 1)
    right = np.minimum.accumulate(np.where(known, c, mean.shape[1])[:, ::-1], 1)[:, ::-1]
    inside = (left >= 0) & (right < mean.shape[1])
    a, b = np.clip(left, 0, None), np.clip(right, None, mean.shape[1] - 1)
    rows = np.arange(mean.shape[0])[:, None]
    t = np.where(b > a, (c - a) / np.maximum(b - a, 1), 0.0)
    with np.errstate(invalid="ignore"):
        value = (1 - t) * mean[rows, a] + t * mean[rows, b]
    return np.where(inside, value, 0.0), np.where(inside, (b - a).astype(float), np.inf)


def filled(mean: np.ndarray) -> np.ndarray:
    """mean with its holes (not-a-number) interpolated; all holes where nothing is known."""
    known = np.isfinite(mean)
    if known.all() or not known.any():
        return mean
    (x, across), (y, down) = along(mean, known), (v.T for v in along(mean.T, known.T))
    w, u = 1 / np.maximum(across, 1e-9), 1 / np.maximum(down, 1e-9)
    with np.errstate(invalid="ignore"):
        between = (w * x + u * y) / (w + u)
    out = np.where(np.isfinite(across) | np.isfinite(down), between, mean.ravel()[nearest_known(known)[1]])
    return np.where(known, mean, out)


def ground_cells(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """r, c, z: the mean of the ground returns (class 2) of each cell that has any."""
    at = [F.floor(F.col(v) / F.lit(cell)).cast("int").alias(n) for v, n in (("y", "r"), ("x", "c"))]
    return points.where("classification = 2").groupBy(*at).agg(F.avg("z").alias("z"))


def ground(cells: DataFrame, wanted: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """r, c, z of the wanted places (r, c), from known cells (r, c, z). A block sees the known cells within margin around it; a place
    of a block that sees none has a null z."""
    near = lambda x: F.sequence(F.floor((F.col(x) - margin) / block).cast("int"), F.floor((F.col(x) + margin) / block).cast("int"))
    seen = cells.withColumn("br", F.explode(near("r"))).withColumn("bc", F.explode(near("c"))).select("br", "bc", "r", "c", "z")
    asked = wanted.select("r", "c").distinct().withColumns({"br": F.floor(F.col("r") / block).cast("int"), "bc": F.floor(F.col("c") / block).cast("int")})

    def run(key: tuple, want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if want.empty:
            return pd.DataFrame({"r": [], "c": [], "z": []})
        r0, c0 = key[0] * block - margin, key[1] * block - margin
        mean = np.full((block + 2 * margin, block + 2 * margin), np.nan)
        inside = have[(have["r"] >= r0) & (have["r"] < r0 + len(mean)) & (have["c"] >= c0) & (have["c"] < c0 + len(mean))]
        mean[inside["r"] - r0, inside["c"] - c0] = inside["z"].astype(float)
        return pd.DataFrame({"r": want["r"], "c": want["c"], "z": filled(mean)[want["r"] - r0, want["c"] - c0]})

    got = asked.groupBy("br", "bc").cogroup(seen.groupBy("br", "bc")).applyInPandas(run, "r int, c int, z double")
    return got.withColumn("z", F.nanvl("z", F.lit(None).cast("double")))
