"""Cell heights: zonal top and mean, calibration, provenance, expected error, fine product, accuracy.

Nulls stand for no data. Comparisons inside flags are coalesced to false, as for not-a-number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves


def cell_top_and_mean(pixels: DataFrame, expected: float) -> DataFrame:
    """cell_id, top, mean, n: pixels above -1 and below 150, negatives as 0; top and mean null under half of expected."""
    v = F.greatest(F.col("v"), F.lit(0.0))
    cells = pixels.where((F.col("v") > -1) & (F.col("v") < 150)).groupBy("cell_id").agg(F.max(v).alias("top"), F.avg(v).alias("mean"), F.count("*").alias("n"))
    enough = F.col("n") >= 0.5 * expected
    return cells.select("cell_id", F.when(enough, F.col("top")).alias("top"), F.when(enough, F.col("mean")).alias("mean"), "n")


def calibrate(meta: Column, eth: Column) -> dict[str, Column]:
    """mc, ec, weight, height, matched of a cell."""
    mc, ec = curves.lookup(meta, curves.META), curves.lookup(eth, curves.ETH)
    w = curves.lookup((mc + ec) / 2, curves.WEIGHT, extend=False)
    both = meta.isNotNull() & eth.isNotNull()
    weight = F.when(both, w).when(meta.isNotNull(), 1.0).when(eth.isNotNull(), 0.0)
    height = F.when(both, w * mc + (1 - w) * ec).otherwise(F.coalesce(mc, ec))
    return {"mc": mc, "ec": ec, "weight": weight, "height": height, "matched": curves.lookup(meta, curves.MATCHED)}


def cells_of_sources(pixels: DataFrame, cell: float = 10.0) -> DataFrame:
    """As cell_top_and_mean over several sources (source, its place in order; pixel, its pixel's size): a cell expects as many pixels as
    the last source has in one, and needs half of them; the others add theirs."""
    expected = pixels.agg(F.pow(F.lit(cell) / F.abs(F.max_by("pixel", "source")), 2).alias("expected"))
    v = F.greatest(F.col("v"), F.lit(0.0))
    cells = pixels.where((F.col("v") > -1) & (F.col("v") < 150)).groupBy("cell_id").agg(F.max(v).alias("top"), F.avg(v).alias("mean"), F.count("*").alias("n")).join(F.broadcast(expected))  # one row
    enough = (F.col("n") >= 0.5 * F.col("expected")) & (F.col("n") > 0)
    return cells.select("cell_id", F.when(enough, F.col("top")).alias("top"), F.when(enough, F.col("mean")).alias("mean"), "n")


def applied(cells: DataFrame, recent: bool = False) -> DataFrame:
    """cells (cell_id, top, eth_m, and meta_date where recent) with the calibrated readings; recent takes the later map where the
    years differ, and without dates is an error."""
    if recent and "meta_date" not in cells.columns:
        raise ValueError("recent needs image dates (meta_date)")
    out = cells.withColumns(calibrate(F.col("top"), F.col("eth_m")))
    return most_recent(out) if recent else out


def most_recent(cells: DataFrame) -> DataFrame:
    """Where both maps have a value and the image year is known and not 2020, the later image alone counts."""
    year = F.floor(F.col("meta_date") / 10000)
    both = F.coalesce(F.col("mc").isNotNull() & F.col("ec").isNotNull() & (year > 0) & (year != 2020), F.lit(False))
    later = (year > 2020).cast("double")
    return cells.withColumns({"height": F.when(both, F.when(later == 1, F.col("mc")).otherwise(F.col("ec"))).otherwise(F.col("height")), "weight": F.when(both, later).otherwise(F.col("weight"))})


def provenance(cells: DataFrame) -> DataFrame:
    """source, weight_on_meta_pct, year, meta_year, meta_month, eth_year, flags."""
    m, e, date, w = F.col("top"), F.col("eth_m"), F.coalesce("meta_date", F.lit(0)), F.col("weight")
    meta_year = F.when(m.isNotNull(), F.floor(date / 10000)).otherwise(0)
    eth_year = F.when(e.isNotNull(), 2020).otherwise(0)
    bit = lambda c, b: F.coalesce(c, F.lit(False)).cast("int") * b
    return cells.select(
        "cell_id",
        F.when(m.isNotNull() & e.isNotNull(), 3).when(m.isNotNull(), 1).when(e.isNotNull(), 2).otherwise(0).alias("source"),
        F.coalesce(F.bround(100 * w, 0).cast("int"), F.lit(255)).alias("weight_on_meta_pct"),
        F.when(F.coalesce(w >= 0.5, F.lit(False)), meta_year).otherwise(eth_year).cast("int").alias("year"),
        meta_year.cast("int").alias("meta_year"),
        F.when(m.isNotNull(), F.floor(date / 100) % 100).otherwise(0).cast("int").alias("meta_month"),
        eth_year.alias("eth_year"),
        (bit(m > curves.META[-1][0], 1) + bit(e > curves.ETH[-1][0], 2) + bit(F.abs(F.col("mc") - F.col("ec")) >= 10, 4)).alias("flags"),
    )


def expected_error(height: Column, weight: Column | None = None, tables: dict[str, list[tuple[float, float]]] | None = None) -> Column:
    """The mean absolute error of the reading used, in the height's band: the blend's for a weight between 0 and 1 (or where
    no weight is given), one map's calibrated reading for 1 (Meta) and 0 (ETH). tables: (lower edge, error) ascending by
    'blend', 'meta' and 'eth'; a band that a table leaves out takes the next lower one, or its first. Null where a reading
    has no table: the published one holds the blend only."""
    tables = {"blend": list(zip(curves.BANDS, curves.ERRORS, strict=True))} | (tables or {})

    def of(reading: str) -> Column:
        rows = tables.get(reading)
        if not rows:
            return F.lit(None).cast("double")
        out = F.lit(float(rows[0][1]))
        for edge, error in rows[1:]:
            out = F.when(height >= edge, F.lit(float(error))).otherwise(out)
        return F.when(height.isNotNull(), out)

    if weight is None:
        return of("blend")
    return F.when((weight > 0) & (weight < 1), of("blend")).when(weight == 1, of("meta")).when(weight == 0, of("eth"))


def fine_factor(height: Column, top: Column) -> Column:
    return F.when(F.coalesce(top > 0, F.lit(False)), height / F.greatest(top, F.lit(1e-6))).otherwise(1.0)


def fine(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Each fine pixel times its cell's factor. The gather is an equi join; Catalyst broadcasts cells if they are few."""
    factors = cells.select("cell_id", fine_factor(F.col("height"), F.col("top")).alias("factor"))
    return pixels.join(factors, "cell_id").select("r", "c", "cell_id", (F.col("v") * F.col("factor")).alias("p"))


def pyramid(pixels: DataFrame, k: int) -> DataFrame:
    """Average overview of level k, with its band statistics' inputs."""
    side = 1 << k
    return pixels.groupBy(F.floor(F.col("r") / side).cast("int").alias("r"), F.floor(F.col("c") / side).cast("int").alias("c")).agg(F.avg("h").alias("h"))


def errors(rows: DataFrame, reading: str, truth: str, least: int = 1) -> DataFrame:
    """n, MAE, RMSE, bias and median of reading - truth: over all, by band of truth, by band of reading, in one pass."""
    e = F.col(reading) - F.col(truth)
    rows = rows.where(e.isNotNull()).select(e.alias("e"), curves.band(F.col(truth)).alias("truth_band"), curves.band(F.col(reading)).alias("reading_band"))
    out = rows.groupingSets([[], [F.col("truth_band")], [F.col("reading_band")]], F.col("truth_band"), F.col("reading_band")).agg(
        F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.percentile("e", F.lit(0.5)).alias("median"))
    return out.where(F.col("n") >= least)
