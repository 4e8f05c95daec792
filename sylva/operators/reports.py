"""What a run tells in numbers: shares, accuracy of fine pixels, curves of heights, densities, spreads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curves


def told(cells: DataFrame) -> DataFrame:
    """kind, name, share (4 digits, half to even) of provenance rows (source, flags, date): of the cells with a height the shares by
    source and flag, of those read from the first map the shares by image date and of the undated. Shares of nothing are 0."""
    held, first = F.col("source") > 0, F.col("source").isin(1, 3)
    n, m = F.greatest(F.count_if(held), F.lit(1)), F.greatest(F.count_if(first), F.lit(1))
    parts = [("source", name, F.count_if(F.col("source") == code) / n) for name, code in (("both", 3), ("meta_alone", 1), ("eth_alone", 2))]
    parts += [("flags", name, F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) > 0) / n) for name, bit in (("meta_above_table", 1), ("eth_above_table", 2), ("apart", 4))]
    parts += [("undated", "meta_cells_undated", F.count_if(first & (F.col("date") == 0)) / m)]
    fixed = cells.agg(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("name"), s.alias("share")) for k, x, s in parts]).alias("a"), m.alias("m"))
    days = cells.where(first & (F.col("date") > 0)).groupBy("date").agg(F.count("*").alias("k"))
    name = F.date_format(F.to_date(F.col("date").cast("string"), "yyyyMMdd"), "yyyy-MM-dd")
    dated = days.join(F.broadcast(fixed.select("m"))).select(F.lit("date").alias("kind"), name.alias("name"), (F.col("k") / F.col("m")).alias("share"))  # one row
    return fixed.select(F.explode("a").alias("x")).select("x.*").unionByName(dated).withColumn("share", F.bround("share", 4))


def run_shares(cells: DataFrame) -> DataFrame:
    """One row: left_as_read (cells of 2 m and more without a top above 0, of all with a height), beyond_meta and beyond_eth (above
    their curves' last knots, of all cells), eth_read and meta_read, expected_mae (mean of the expected errors)."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    low = (F.col("height") >= curves.BANDS[1]) & ~F.coalesce(F.col("top") > 0, F.lit(False))
    return cells.agg(
        (F.count_if(F.coalesce(low, F.lit(False))) / F.greatest(F.count("height"), F.lit(1))).alias("left_as_read"), share(F.col("top") > curves.META[-1][0]).alias("beyond_meta"), share(F.col("eth_m") > curves.ETH[-1][0]).alias("beyond_eth"),
        share(F.col("eth_m").isNotNull()).alias("eth_read"), share(F.col("top").isNotNull()).alias("meta_read"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("expected_mae"),
    )


def band_rows(accuracy: DataFrame, reading: str, frame: str) -> DataFrame:
    """A reading's accuracy by band (band_m 'lo-hi'): lo, hi and the figures, ascending by lo, each with the next band's lo."""
    edge = lambda i: F.split("band_m", "-")[i].cast("double")
    own = accuracy.where((F.col("reading") == reading) & (F.col("frame") == frame)).select("band_m", edge(0).alias("lo"), edge(1).alias("hi"), "n", "mae")
    return own.withColumn("next_lo", F.lead("lo").over(Window.orderBy("lo")))  # a dimension of a few rows


def fine_errors(pixels: DataFrame, cells: DataFrame, expected: float, least: int = 50) -> DataFrame:
    """Three readings of fine pixels against measured ones. pixels: cell_id, v (the file), truth; cells: cell_id, factor.
    reading (crowns: the file, as_read: over its factor, flat: the cell's mean of the file), band (of the truth, null over all),
    n, mae, rmse, bias; bands of fewer than least pixels go. Measured values outside (-1, 150) or null, cells without a mean (half of expected
    pixels) or a factor above 0 take no part; negative truths are 0."""
    level = pixels.groupBy("cell_id").agg(F.avg(F.greatest("v", F.lit(0.0))).alias("flat"), F.count("*").alias("k")).where(F.col("k") >= 0.5 * expected).drop("k")
    used = pixels.where("truth > -1 and truth < 150").join(level, "cell_id").join(cells.select("cell_id", "factor"), "cell_id").where("factor > 0")
    readings = F.explode(F.array(*[F.struct(F.lit(n).alias("reading"), v.alias("v")) for n, v in (("crowns", F.col("v")), ("as_read", F.col("v") / F.col("factor")), ("flat", F.col("flat")))]))
    truth = F.greatest("truth", F.lit(0.0))
    rows = used.select(curves.band(truth).alias("band"), truth.alias("t"), "v", "factor", "flat").select("band", "t", readings.alias("x")).select("band", "x.reading", (F.col("x.v") - F.col("t")).alias("e"))
    out = rows.groupingSets([[F.col("reading")], [F.col("reading"), F.col("band")]], F.col("reading"), F.col("band")).agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))
    return out.where(F.col("band").isNull() | (F.col("n") >= least))


def cell_mean_errors(pixels: DataFrame, cells: DataFrame, expected: float) -> DataFrame:
    """reading (crowns, as_read), n, mae, rmse, bias of a cell's mean against the measured mean, over cells with at least half of
    the expected pixels and one at least."""
    used = pixels.where("truth > -1 and truth < 150").join(cells.select("cell_id", "factor"), "cell_id").where("factor > 0")
    truth = F.avg(F.greatest("truth", F.lit(0.0)))
    means = used.groupBy("cell_id").agg(F.count("*").alias("k"), (F.avg("v") - truth).alias("crowns"), (F.avg(F.col("v") / F.col("factor")) - truth).alias("as_read")).where(F.col("k") >= max(0.5 * expected, 1))
    each = means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reading"), F.col(n).alias("e")) for n in ("crowns", "as_read")])).alias("x")).select("x.*")
    return each.groupBy("reading").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"))


def kernel(spread: float, step: float) -> dict[int, float]:
    reach = round(4 * spread / step)
    weights = {o: math.exp(-0.5 * (o * step / spread) ** 2) for o in range(-reach, reach + 1)}
    total = sum(weights.values())
    return {o: w / total for o, w in weights.items()}


def height_curve(values: DataFrame, column: str, top: float, spread: float = 1.0, step: float = 0.25) -> DataFrame:
    """height, density (values a metre): counts in bins of step from 0 to top, spread by a Gaussian; what the spreading would put
    outside is folded back at the ends, so the area is the number of values up to top. Values below 0 count as 0."""
    bins = math.ceil(top / step - 1e-9)
    v = F.greatest(F.col(column), F.lit(0.0))
    at = F.least(F.floor(v / step), F.lit(bins - 1)).cast("int")
    counted = values.where(F.col(column).isNotNull() & (v <= bins * step)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    share = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel(spread, step).items()]))
    moved = counted.select("n", "bin", share.alias("k")).select((F.col("bin") + F.col("k.o")).alias("b"), (F.col("n") * F.col("k.w")).alias("w"))
    place = F.pmod("b", F.lit(2 * bins))  # mirrored at both ends
    folded = moved.groupBy(F.when(place < bins, place).otherwise(2 * bins - 1 - place).cast("int").alias("bin")).agg(F.sum("w").alias("w"))
    return folded.select(((F.col("bin") + 0.5) * step).alias("height"), (F.col("w") / step).alias("density"))


def trees_a_hectare(trees: DataFrame, rows: int, cols: int, pixel: float = 1.0, least: float = 20.0) -> DataFrame:
    """r, c, trees_per_ha in cells of least metres or more, so that the longer side has 400 cells at most; x and y from the corner."""
    cell = max(least, pixel * math.ceil(max(rows, cols) / 400))
    return trees.groupBy(F.floor(F.col("y") / cell).cast("int").alias("r"), F.floor(F.col("x") / cell).cast("int").alias("c")).agg((F.count("*") / F.lit(cell * cell / 1e4)).alias("trees_per_ha"))


def diameter_by_height(trees: DataFrame, bands: int = 12, least: int = 10) -> DataFrame:
    """height (a band's middle), diameter (median) in bands up to the highest tree, rounded up to 5 m; bands of fewer than least trees go."""
    tallest = F.broadcast(trees.agg((F.ceil(F.max("height_m") / 5) * 5.0).alias("tallest")))  # one row
    banded = trees.join(tallest).withColumn("band", F.floor(F.col("height_m") / (F.col("tallest") / bands)))
    out = banded.where(F.col("band") < bands).groupBy("band", "tallest").agg(F.percentile("diameter", F.lit(0.5)).alias("diameter"), F.count("*").alias("n")).where(F.col("n") >= least)
    return out.select(((F.col("band") + 0.5) * F.col("tallest") / bands).alias("height"), "diameter", "n")


def spreads(column: Column) -> Column:
    """p5, p25, p50, p75, p95 and max as an array, to two digits, half to even."""
    return F.transform(F.concat(F.percentile(column, F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])), F.array(F.max(column).cast("double"))), lambda v: F.bround(v, 2))


def summary(canopy: DataFrame, label: DataFrame, trees: DataFrame, pixel: float = 1.0, min_height: float = 2.0) -> DataFrame:
    """One row: trees, area_with_data_ha, trees_per_ha, canopy_cover, canopy_in_crowns, height, diameter (arrays of spreads), crowns_at_edge."""
    land = canopy.agg(F.count("h").alias("held"), F.count_if(F.col("h") >= min_height).alias("cover"))
    own = label.agg(F.count("*").alias("crowned"))
    some = trees.agg(F.count("*").alias("trees"), spreads(F.col("height_m")).alias("height"), spreads(F.col("diameter")).alias("diameter"), F.count_if("at_edge").alias("crowns_at_edge"))
    hectares = F.col("held") * F.lit(pixel * pixel / 1e4)
    return land.join(own).join(some).select(  # one row each
        "trees", F.bround(hectares, 2).alias("area_with_data_ha"), F.bround(F.col("trees") / F.greatest(hectares, F.lit(1e-9)), 1).alias("trees_per_ha"), F.bround(F.col("cover") / F.greatest("held", F.lit(1)), 3).alias("canopy_cover"),
        F.bround(F.col("crowned") / F.greatest("cover", F.lit(1)), 3).alias("canopy_in_crowns"), "height", "diameter", "crowns_at_edge",
    )


def crown_measures(label: DataFrame, rows: int, cols: int, pixel: float = 1.0, stem_share: float = 0.15) -> DataFrame:
    """Of crowns as pixels (r, c, tree_id, h): area, mean, diameter, the highest pixel (the first in row-major order), the lowest
    height, and the middle of the upper stem_share of its height range, weighted by the height above it (null if flat)."""
    w = Window.partitionBy("tree_id")
    upper = label.withColumns({"top": F.max("h").over(w), "low": F.min("h").over(w)})
    upper = upper.withColumn("w", F.greatest(F.col("h") - (F.col("top") - stem_share * (F.col("top") - F.col("low"))), F.lit(0.0)))
    middle = lambda n: F.sum(F.col("w") * (F.col(n) + 0.5)) / F.nullif(F.sum("w"), F.lit(0.0))
    area = F.count("*") * F.lit(pixel * pixel)
    return upper.groupBy("tree_id").agg(area.alias("area"), F.avg("h").alias("mean"), (2 * F.sqrt(area / math.pi)).alias("diameter"), F.max_by(F.struct("r", "c"), F.struct("h", -F.col("r"), -F.col("c"))).alias("at"), F.min("h").alias("low"), middle("r").alias("stem_r"), middle("c").alias("stem_c")).select("tree_id", "area", "mean", "diameter", F.col("at.r").alias("top_r"), F.col("at.c").alias("top_c"), "low", "stem_r", "stem_c")


def edge_crowns(label: DataFrame, canopy: DataFrame) -> DataFrame:
    """tree_id of the crowns that touch by a side a place without data (or beyond the raster)."""
    sides = F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0))]))
    return label.select("tree_id", sides.alias("s")).select("tree_id", "s.r", "s.c").join(canopy.where("h is not null").select("r", "c"), ["r", "c"], "left_anti").select("tree_id").distinct()
