"""Rasters as tables by tile, with the statistics of each band beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tiled(px: DataFrame, side: int = 4096) -> DataFrame:
    """px (r, c, ...) with tile, a name by the tile's row and column."""
    place = lambda x: F.floor(F.col(x) / side).cast("string")
    return px.withColumn("tile", F.concat_ws("_", place("r"), place("c")))


def statistics(px: DataFrame, *by: str, band: str = "h", codes: bool = False) -> DataFrame:
    """min, max, mean, std (of all) and n of a band's values; of codes, those above 0. Null and not-a-number count nowhere."""
    value = F.when(F.col(band) > 0, F.col(band)) if codes else F.when(~F.isnan(F.col(band).cast("double")), F.col(band))
    return px.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def write(px: DataFrame, path: str, bands: list[str], side: int = 4096, salt: int = 8) -> None:
    """Parquet by tile, rows in order, and path/_statistics, a row for each band. A tile's pixels go to at most salt tasks by rows,
    so that a large tile is not one task's work; Spark's committer replaces the table as a whole."""
    own = tiled(px, side).withColumn("_part", F.pmod(F.floor(F.col("r") / max(side // salt, 1)), F.lit(salt)))
    own.repartition("tile", "_part").sortWithinPartitions("tile", "r", "c").drop("_part").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/pixels")
    each = [statistics(px, band=b).withColumn("band", F.lit(b)).select("band", *[F.col(c).cast("double" if c != "n" else "long").alias(c) for c in ("min", "max", "mean", "std", "n")]) for b in bands]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    out.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/pixels")
