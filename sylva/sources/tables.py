"""Lookup curves and accuracy rows from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURVES = "kind string, region string, model string, x_m double, y double"
ACCURACY = "region string, fit string, reading string, frame string, band_m string, n long, mae double, rmse double, bias double, median double"


def curves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CURVES)


def accuracy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=ACCURACY)


def curve(rows: DataFrame, kind: str, region: str, model: str) -> list[tuple[float, float]]:
    """The knots of one curve (some ten rows), ascending; an unknown region or model is an error."""
    found = rows.where((F.col("kind") == kind) & (F.col("region") == region) & (F.col("model") == model)).select("x_m", "y").orderBy("x_m").collect()
    if not found:
        raise ValueError(f"no curve {kind} of {model} for the region {region!r}")
    return [(float(r.x_m), float(r.y)) for r in found]


def table(rows: DataFrame, region: str = "pooled", meta: str = "meta_v1") -> dict[str, list[tuple[float, float]]]:
    """The four curves of a region: meta, eth, matched, weight."""
    wanted = {"meta": ("calibrated", meta), "eth": ("calibrated", "eth"), "matched": ("matched", meta), "weight": ("weight", meta)}
    return {name: curve(rows, kind, region, model) for name, (kind, model) in wanted.items()}


def preferred(rows: DataFrame) -> DataFrame:
    """The accuracy rows of all sites: those of unseen sites if there is any, else the pooled ones."""
    some = F.max(F.col("fit") == "unseen").over(Window.partitionBy())  # a dimension of a few hundred rows
    return rows.where("region = 'all'").withColumn("_some", some).where(F.col("fit") == F.when(F.col("_some"), "unseen").otherwise("pooled")).drop("_some")


def errors(rows: DataFrame, meta: str = "meta_v1") -> dict[str, list[tuple[float, float]]]:
    """For heights.expected_error: (lower edge, mean absolute error) of the blend and of each map's calibrated reading."""
    out = {}
    for name, reading in (("blend", "blend"), ("meta", f"{meta} calibrated"), ("eth", "eth calibrated")):
        own = preferred(rows).where((F.col("reading") == reading) & (F.col("frame") == "by_value")).select(F.split("band_m", "-")[0].cast("double").alias("lo"), "mae").orderBy("lo").collect()  # some ten bands
        out[name] = [(r.lo, r.mae) for r in own]
    return out
