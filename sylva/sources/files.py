"""Files that may be missing, and a read-through cache; both through Hadoop's file systems."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in order: a missing tile is no error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, x in zip(paths, at, strict=True) if x.getFileSystem(conf).exists(x)]


def tried(read: Callable[[], bytes | None], tries: int = 4, wait: float = 2.0) -> bytes | None:
    """read(), again after 1, 2, 3 times wait seconds where it fails; FileNotFoundError means None, the last failure is raised."""
    for attempt in range(1, tries + 1):
        try:
            return read()
        except FileNotFoundError:
            return None
        except OSError:
            if attempt == tries:
                raise
            time.sleep(wait * attempt)
    return None


def kept(spark: SparkSession, source: str, cache: str | None, read: Callable[[], bytes | None]) -> tuple[bytes | None, bool]:
    """The bytes of a source and whether they came from the cache, a folder that keeps what is read under the source's own path.
    A file takes its name only once it is whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if cache is None or "://" not in source:
        return tried(read), False
    path = jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/{source.split('://', 1)[1].lstrip('/')}")
    store = path.getFileSystem(conf)
    if store.exists(path):
        stream = store.open(path)
        try:
            return bytes(stream.readAllBytes()), True
        finally:
            stream.close()
    data = tried(read)
    if data is not None:
        part = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}.part")
        out = store.create(part, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        if not store.rename(part, path) and not store.exists(path):
            raise OSError(f"{path} could not be kept")
    return data, False
