"""A run's folder: results are staged, take their names together at the end, and give way to the old ones if anything fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """Names of a folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.of = jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self.store = self.of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.store.exists(self.of(f"{self.path}/{name}"))

    def move(self, name: str, to: str) -> None:
        if not self.store.rename(self.of(f"{self.path}/{name}"), self.of(f"{self.path}/{to}")):
            raise OSError(f"{self.path}/{name} could not be renamed to {to}")

    def remove(self, name: str) -> None:
        self.store.delete(self.of(f"{self.path}/{name}"), True)

    def write(self, name: str, data: bytes) -> None:
        out = self.store.create(self.of(f"{self.path}/{name}"), True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()


@contextmanager
def replaced(spark: SparkSession, path: str, own: list[str]) -> Iterator[str]:
    """Gives a staging folder inside path. At the end what was written there takes its place, and names of `own` that were not
    written again go; on any failure the folder is as it was. Names that are not in own are never touched."""
    folder, mark = Folder(spark, path), uuid.uuid4().hex
    staged = f".staged-{mark}"
    folder.store.mkdirs(folder.of(f"{folder.path}/{staged}"))
    aside: list[str] = []
    placed: list[str] = []
    try:
        yield f"{folder.path}/{staged}"
        for name in own:
            if folder.exists(name):
                folder.move(name, f".replaced-{mark}-{name}")
                aside.append(name)
            if folder.exists(f"{staged}/{name}"):
                folder.move(f"{staged}/{name}", name)
                placed.append(name)
    except BaseException:
        for name in placed:
            folder.remove(name)
        for name in aside:
            folder.move(f".replaced-{mark}-{name}", name)
        raise
    finally:
        folder.remove(staged)
    for name in aside:
        folder.remove(f".replaced-{mark}-{name}")


def document(spark: SparkSession, path: str, name: str, content: dict) -> None:
    """A JSON document; DataFrames in it (reports of a few rows) become lists of rows, or one object where they have one row."""

    def plain(x: object) -> object:
        if isinstance(x, DataFrame):
            rows = [json.loads(r[0]) for r in x.limit(10_000).select(F.to_json(F.struct(*x.columns), {"ignoreNullFields": "false"})).collect()]
            return rows[0] if len(rows) == 1 else rows
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    Folder(spark, path).write(name, json.dumps(plain(content), indent=1).encode())


def vectors(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table with rings as Parquet, or as GeoJSON features, a line each."""
    from ..sources import geojson

    if kind == "parquet":
        rows.write.mode("overwrite").parquet(path)
    elif kind == "geojson":
        geojson.written(rows).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"vectors: {kind}")


def readme(spark: SparkSession, path: str, title: str, figures: dict[str, object]) -> None:
    """A short markdown page of a run's figures."""
    lines = [f"# {title}", "", "| figure | value |", "|-|-|", *[f"| {k} | {v} |" for k, v in figures.items()], ""]
    Folder(spark, path).write("README.md", "\n".join(lines).encode())
