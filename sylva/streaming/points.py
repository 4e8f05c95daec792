"""Points that arrive over time, as cells: the state is a maximum, a sum and counts a cell, which merge in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "x double, y double, z double, classification int, return_number int"
#: Classes that are neither ground nor canopy: noise, water, structures and wires (fixed values).
NOT_CANOPY = [6, 7, 9, 13, 14, 15, 16, 17, 18]


def arriving(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """A stream of the Parquet files of points that appear in a folder."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def cells(points: DataFrame, pixel: float = 1.0) -> DataFrame:
    """r, c, top (highest canopy point), ground (mean of class 2), n, first_returns; for streams in update or complete mode.

    Points without a position count nowhere; a null class is canopy; a cell without ground points has a null ground.
    """
    canopy = F.coalesce(~F.col("classification").isin(NOT_CANOPY), F.lit(True))
    at = [F.floor(F.col(v) / F.lit(pixel)).cast("int").alias(n) for v, n in (("y", "r"), ("x", "c"))]
    return points.where("x is not null and y is not null").groupBy(*at).agg(
        F.max(F.when(canopy, F.col("z"))).alias("top"),
        F.avg(F.when(F.col("classification") == 2, F.col("z"))).alias("ground"),
        F.count("*").alias("n"),
        F.count_if(F.col("return_number") == 1).alias("first_returns"),
    )
