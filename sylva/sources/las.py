"""LAS point files (versions 1.0 to 1.4, uncompressed): headers on the driver, records in ranges on the workers."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Records of a range.
BLOCK = 500_000
POINTS = "x double, y double, z double, classification int, return_number int"


@dataclass(frozen=True)
class Header:
    """What the first 375 bytes say. first_returns: of the legacy table where it is filled, else all points."""

    path: str
    start: int
    kind: int
    stride: int
    points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    most: tuple[float, float, float]
    least: tuple[float, float, float]
    first_returns: int


def header(uri: str) -> Header:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError(f"{uri} is no LAS file")
    if h[104] & 0x80:
        raise ValueError(f"{uri} is compressed: LAZ is not read")
    start, kind, stride, legacy = struct.unpack_from("<I", h, 96)[0], h[104], *struct.unpack_from("<HI", h, 105)
    by_return = struct.unpack_from("<5I", h, 111)
    scale, offset = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    bounds = struct.unpack_from("<6d", h, 179)
    points, first = legacy, by_return[0]
    if (h[24], h[25]) >= (1, 4) and len(h) >= 375:
        points = struct.unpack_from("<Q", h, 247)[0] or legacy
        first = struct.unpack_from("<Q", h, 255)[0] or first
    return Header(uri, start, kind, stride, points, scale, offset, bounds[0::2], bounds[1::2], first or points)


def density(headers: list[Header]) -> float:
    """First returns a square unit over the sum of the files' boxes."""
    area = sum((h.most[0] - h.least[0]) * (h.most[1] - h.least[1]) for h in headers)
    return sum(h.first_returns for h in headers) / area if area > 0 else 0.0


def records(data: bytes, h: Header) -> pd.DataFrame:
    n = len(data) // h.stride
    at = lambda place, kind: np.ndarray((n,), kind, data, place, (h.stride,))
    xyz = [at(4 * k, "<i4") * h.scale[k] + h.offset[k] for k in range(3)]
    wide = h.kind >= 6
    returns, classes = at(14, "u1") & (15 if wide else 7), at(16, "u1") if wide else at(15, "u1") & 31
    return pd.DataFrame({"x": xyz[0], "y": xyz[1], "z": xyz[2], "classification": classes.astype(np.int32), "return_number": returns.astype(np.int32)})


def read(spark: SparkSession, uris: list[str], block: int = BLOCK) -> DataFrame:
    """x, y, z, classification, return_number of all points; paths must be readable by all executors. No file gives no row."""
    headers = [header(u) for u in uris]
    ranges = [(i, at, min(block, h.points - at)) for i, h in enumerate(headers) for at in range(0, h.points, block)]
    parts = spark.createDataFrame(ranges, "file int, at long, n long").repartition(max(1, len(ranges)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for x in pdf.itertuples():
                h = headers[x.file]
                store, path = fs.FileSystem.from_uri(h.path)
                with store.open_input_file(path) as f:
                    f.seek(h.start + x.at * h.stride)
                    yield records(f.read(x.n * h.stride), h)

    return parts.mapInPandas(run, POINTS)
