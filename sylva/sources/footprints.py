"""Building files: pruning by a manifest, the windowed scan, and a pinned copy with its receipt."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def in_window(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose bbox (xmin, xmax, ymin, ymax) meets the closed window, by id. The comparisons are on plain nested fields, so that
    they reach the Parquet scan."""
    return rows.where((F.col("bbox.xmax") >= west) & (F.col("bbox.xmin") <= east) & (F.col("bbox.ymax") >= south) & (F.col("bbox.ymin") <= north)).orderBy("id")


def selected(manifest: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """manifest (bbox: array of west, south, east, north) with selected: whether a file's extent meets the closed window."""
    b = F.col("bbox")
    return manifest.withColumn("selected", (b[2] >= west) & (b[0] <= east) & (b[3] >= south) & (b[1] <= north))


def files(manifest: DataFrame, expected: int, prefix: str, west: float, south: float, east: float, north: float) -> list[str]:
    """Paths (href) of the files that meet the window, each once, in order; an incomplete index or a path outside prefix is an error.
    A manifest is a list of files, some hundreds."""
    rows = selected(manifest, west, south, east, north).select("href", "selected").collect()
    if not rows or len(rows) != expected or any(not r.href.startswith(prefix) or not r.href.endswith(".parquet") for r in rows):
        raise ValueError("the file index is incomplete or outside the requested release")
    return sorted({r.href for r in rows if r.selected})


def checksum(spark: SparkSession, path: str) -> str:
    """sha256 over the names and contents of the files of a folder (or of one file), computed where the files are read."""
    each = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))
    sums = each.select(F.concat_ws(" ", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).alias("s"))
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("s")), "\n").cast("binary"), 256).alias("h")).first()["h"]  # a line a file


def pinned(spark: SparkSession, folder: str, bounds: tuple[float, float, float, float], fetch) -> DataFrame:  # noqa: ANN001
    """The buildings of a window, fetched once into a local folder and pinned by a receipt of window, release and checksum: a second
    run reads the copy; another window or a changed copy is an error. fetch(bounds) gives (release, DataFrame)."""
    bounds = [round(float(v), 9) for v in bounds]
    receipt = os.path.join(folder, "buildings.json")
    if os.path.exists(receipt):
        with open(receipt) as f:
            record = json.load(f)
        path = os.path.join(folder, os.path.basename(record["file"]))
        if record["bbox"] != bounds:
            raise ValueError("the pinned buildings belong to another area: use a new folder")
        if checksum(spark, path) != record["sha256"]:
            raise ValueError("the pinned building file changed: inspect it before reusing the run")
        return spark.read.parquet(path)
    release, rows = fetch(tuple(bounds))
    path = os.path.join(folder, f"buildings__{release[:10]}__src.parquet")
    rows.write.mode("overwrite").parquet(path)
    record = {"bbox": bounds, "release": release, "file": os.path.basename(path), "features": spark.read.parquet(path).count(), "sha256": checksum(spark, path)}
    with open(receipt + ".part", "w") as f:
        json.dump(record, f, indent=2)
    os.replace(receipt + ".part", receipt)
    return spark.read.parquet(path)
