"""Connected regions of a pixel table: components by sides or corners, and what is told of the gaps between crowns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDES = [(0, 1), (1, 0)]
CORNERS = [(0, 1), (1, -1), (1, 0), (1, 1)]
#: Side of a tile in pixels.
TILE = 512


def local_roots(r: np.ndarray, c: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Of each pixel, in row-major order, the place of the first that it hangs together with."""
    width = int(c.max() - c.min()) + 3
    key = (r - r.min()) * width + c - c.min() + 1
    ends = []
    for a, b in offsets:
        wanted = key + a * width + b
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        here = np.flatnonzero(key[at] == wanted)
        ends.append((here, at[here]))
    x, y = (np.concatenate(e) for e in zip(*ends, strict=True))
    root = np.arange(len(key))
    while True:
        new, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def components(px: DataFrame, durable: Callable[[DataFrame], DataFrame], corners: bool = False, same: str | None = None, tile: int = TILE) -> DataFrame:
    """r, c, root (struct of the region's first pixel in row-major order) of pixels that hang together by sides, or by corners too;
    `same`: only pixels alike in that column do. Each tile finds its own regions; those that meet across a tile's edge are joined
    over the table: a pass takes the least root of a region's neighbours, then the root's own root, so that roots travel in doubling
    steps, and its length grows with the tiles, not with the pixels."""
    offsets = CORNERS if corners else SIDES
    keep = [same] if same else []
    kinds = dict(px.dtypes)
    place = lambda x: F.floor(F.col(x) / tile).cast("int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"], ignore_index=True).drop_duplicates(["r", "c"], ignore_index=True)
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        root = local_roots(r, c, offsets)
        return pd.DataFrame({"r": r, "c": c, "root_r": r[root], "root_c": c[root], **{k: pdf[k] for k in keep}})

    dealt = px.select("r", "c", *keep).where("r is not null and c is not null").withColumns({"tile_r": place("r"), "tile_c": place("c")})
    schema = ", ".join(f"`{n}` {t}" for n, t in [("r", kinds["r"]), ("c", kinds["c"]), ("root_r", kinds["r"]), ("root_c", kinds["c"]), *[(k, kinds[k]) for k in keep]])
    local = dealt.groupBy("tile_r", "tile_c", *keep).applyInPandas(run, schema)
    local = durable(local.select("r", "c", *keep, F.struct(F.col("root_r").alias("r"), F.col("root_c").alias("c")).alias("own")))
    asked = local.select("r", "c", "own", *keep, F.explode(F.array(*[F.struct((F.col("r") + a).alias("nr"), (F.col("c") + b).alias("nc")) for a, b in offsets])).alias("s")).select("r", "c", "own", *keep, "s.*")
    asked = asked.where((place("nr") != place("r")) | (place("nc") != place("c"))).drop("r", "c")  # across a tile's edge
    beside = asked.join(local.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("own").alias("to"), *[F.col(same).alias("_other")] if same else []), ["nr", "nc"])
    links = beside.where(F.col(same).eqNullSafe(F.col("_other"))) if same else beside
    links = links.select(F.col("own").alias("a"), F.col("to").alias("b")).distinct()
    links = durable(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    if links.isEmpty():
        return local.select("r", "c", F.col("own").alias("root"))
    named = durable(links.select(F.col("a").alias("p")).distinct().withColumn("root", F.col("p")))
    while True:
        least = links.join(named.select(F.col("p").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        new = named.join(least, named["p"] == least["a"], "left").select("p", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        far = new.select(F.col("p").alias("q"), F.col("root").alias("far"))
        jumped = new.join(far, new["root"] == far["q"], "left").select("p", "old", F.least("root", "far").alias("root"))
        named = durable(jumped.select("p", "root", (F.col("old") != F.least("root", "old")).alias("moved")))
        if named.where("moved").isEmpty():
            break
        named = named.drop("moved")
    met = local.join(named.select(F.col("p").alias("own"), F.col("root").alias("_far")), "own", "left")
    return met.select("r", "c", F.coalesce("_far", "own").alias("root"))


def gaps(label: DataFrame, canopy: DataFrame, durable: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """root, size, low and high (the least and the largest crown beside the gap by a side), border (it touches the raster's edge) of each
    region of canopy pixels without a crown."""
    empty = canopy.select("r", "c").join(label.select("r", "c"), ["r", "c"], "left_anti")
    named = durable(components(empty, durable, corners=True))
    size = canopy.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    own = named.join(F.broadcast(size)).groupBy("root").agg(F.count("*").alias("size"), F.bool_or((F.col("r") == F.col("r0")) | (F.col("r") == F.col("r1")) | (F.col("c") == F.col("c0")) | (F.col("c") == F.col("c1"))).alias("border"))  # one row
    sides = F.explode(F.array(*[F.struct((F.col("r") + a).alias("nr"), (F.col("c") + b).alias("nc")) for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0))]))
    beside = named.select("root", "r", "c", sides.alias("s")).select("root", "s.*").join(label.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "tree_id"), ["nr", "nc"]).groupBy("root").agg(F.min("tree_id").alias("low"), F.max("tree_id").alias("high"))
    return own.join(beside, "root", "left").select("root", "size", "low", "high", "border")
