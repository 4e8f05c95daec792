"""Planes laid over each other: warps, windows, cleaning, terrain, mosaics. Rows and columns grow downwards and to the right; a
pixel's middle is at (column + 0.5, row + 0.5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Heights as canopy: not finite or the no-data value is null, negative ones are 0."""
    h = F.col("h").cast("double")
    ok = ~F.isnan(h) & (F.abs(h) < float("inf"))
    if nodata is not None:
        ok = ok & (h != nodata)
    return px.withColumn("h", F.when(ok, F.greatest(h, F.lit(0.0))))


def window(px: DataFrame, top: float, left: float, bottom: float, right: float) -> DataFrame:
    """The pixels that a box in fractional rows and columns meets, as whole rows and columns; the comparison reaches the scan."""
    rows = F.col("r").between(F.floor(F.lit(top)).cast("int"), (F.ceil(F.lit(bottom)) - 1).cast("int"))
    return px.where(rows & F.col("c").between(F.floor(F.lit(left)).cast("int"), (F.ceil(F.lit(right)) - 1).cast("int")))


def warped(source: DataFrame, targets: DataFrame, nodata: float | None = None, clamp: bool = False) -> DataFrame:
    """targets (id, x, y: places in the source's columns and rows) with h, bilinear between the four pixel middles around, weights
    renewed over those with data; null where none has any. clamp: places beyond the outermost middles take the edge's values."""
    sound = source.where("h is not null")
    if nodata is not None:
        sound = sound.where(F.col("h") != nodata)
    x, y = F.col("x") - 0.5, F.col("y") - 0.5
    if clamp:
        size = source.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        targets = targets.join(F.broadcast(size))  # one row
        x, y = F.least(F.greatest(x, F.col("c0")), F.col("c1")), F.least(F.greatest(y, F.col("r0")), F.col("r1"))
    corner = lambda a, b: F.struct((F.floor(y) + a).cast("int").alias("r"), (F.floor(x) + b).cast("int").alias("c"), ((y - F.floor(y) if a else 1 - (y - F.floor(y))) * (x - F.floor(x) if b else 1 - (x - F.floor(x)))).alias("w"))
    asked = targets.select("id", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("k")).select("id", "k.*").where("w > 0")
    met = asked.join(sound.select("r", "c", "h"), ["r", "c"]).groupBy("id").agg((F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("h"))
    return targets.select("id").join(met, "id", "left")


def overlaid(planes: DataFrame, key: str = "id") -> DataFrame:
    """Of several tiles' values (key, tile, h) the last tile's that has one."""
    return planes.groupBy(key).agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("tile"))).alias("h"))


def first_of(planes: DataFrame) -> DataFrame:
    """Of several tiles' pixels (r, c, tile, h) the first tile's that has one."""
    return planes.groupBy("r", "c").agg(F.min_by("h", F.when(F.col("h").isNotNull(), F.col("tile"))).alias("h"))


def terrain_mean(bare: DataFrame, top: DataFrame) -> DataFrame:
    """r, c, z: the mean of two elevations where both are known, else the known one."""
    both = bare.select("r", "c", F.col("z").alias("a")).join(top.select("r", "c", F.col("z").alias("b")), ["r", "c"], "full")
    return both.select("r", "c", F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b").alias("z"))


def above_ground(tops: DataFrame, terrain: DataFrame) -> DataFrame:
    """r, c, h: the highest return less the ground, never below 0; null without either."""
    joined = tops.select("r", "c", F.col("h").alias("top")).join(terrain.select("r", "c", "z"), ["r", "c"], "left")
    return joined.select("r", "c", F.when(F.col("top").isNotNull() & F.col("z").isNotNull(), F.greatest(F.col("top") - F.col("z"), F.lit(0.0))).alias("h"))


def summits(px: DataFrame, tops: DataFrame) -> DataFrame:
    """r, c, dy, dx: how far from its middle each top lies, by the parabola through it and its neighbours along each axis, within
    0.49; 0 where it does not bend down or a neighbour is missing."""
    steps = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1), "here": (0, 0)}
    asked = tops.select("r", "c", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), (F.col("r") + a).alias("nr"), (F.col("c") + b).alias("nc")) for n, (a, b) in steps.items()])).alias("s")).select("r", "c", "s.*")
    met = asked.join(px.select(F.col("r").alias("nr"), F.col("c").alias("nc"), "h"), ["nr", "nc"], "left")
    wide = met.groupBy("r", "c").agg(*[F.max(F.when(F.col("side") == n, F.col("h"))).alias(n) for n in steps])

    def vertex(before: str, after: str) -> Column:
        bend = F.col(before) - 2 * F.col("here") + F.col(after)
        return F.when(bend < 0, F.greatest(F.lit(-0.49), F.least(F.lit(0.49), (F.col(before) - F.col(after)) / (2 * bend)))).otherwise(0.0)

    return wide.select("r", "c", vertex("up", "down").alias("dy"), vertex("left", "right").alias("dx"))


def mosaic_years(tiles: DataFrame) -> DataFrame:
    """years (ascending) and complete (every tile has some) of tiles with years (array); tiles must share crs and pixel."""
    alike = tiles.agg(F.count_distinct(F.struct("crs", "pixel")).alias("kinds"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("years")))).alias("years"), F.bool_and(F.size("years") > 0).alias("complete"))
    return alike.select(F.when(F.col("kinds") <= 1, F.col("years")).otherwise(F.raise_error(F.lit("tiles must share a CRS and resolution")).cast("array<int>")).alias("years"), "complete")


def years_of(tags: DataFrame) -> DataFrame:
    """tags (file, tags: map, band_years: array) with years: those of the tag acquisition_years (a JSON list), of acquisition_year
    and acquisition_date, and of the bands (1800 to 2200); none where the dates are said to be incomplete."""
    from .buildings import year

    told = F.transform(F.from_json(F.col("tags")["acquisition_years"], "array<string>"), year)
    one = F.filter(F.array(year(F.col("tags")["acquisition_year"]), year(F.col("tags")["acquisition_date"])), lambda y: y.isNotNull())
    bands = F.filter(F.coalesce("band_years", F.array().cast("array<int>")), lambda y: y.between(1800, 2200))
    none = F.array().cast("array<int>")
    all_ = F.sort_array(F.array_distinct(F.concat(F.coalesce(told, none), one, bands)))
    return tags.withColumn("years", F.when(F.lower(F.coalesce(F.col("tags")["acquisition_dates_complete"], F.lit("true"))) == "false", none).otherwise(all_))


def halvings(width: int, height: int) -> list[int]:
    """The overviews of a raster: powers of two up to 256, while the longer side holds 256 pixels there."""
    return [2**k for k in range(1, 9) if max(width, height) >> k >= 256]


def thinned(px: DataFrame, k: int) -> DataFrame:
    """Nearest overview of whole-number codes: of each block of 2^k pixels the one in its middle."""
    side, half = 1 << k, (1 << k) // 2
    middle = px.where((F.pmod("r", F.lit(side)) == half) & (F.pmod("c", F.lit(side)) == half))
    return middle.select(F.floor(F.col("r") / side).cast("int").alias("r"), F.floor(F.col("c") / side).cast("int").alias("c"), "h")
