"""What the text operators share: tables, batches, durable cuts, and vectorised word hashing."""

from __future__ import annotations

import gc
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose hash a worker keeps; beyond it a hash is computed again, with the same result.
KEPT_WORDS = 400_000
#: Words that a task gathers before it hands them on, whatever the size of its partition.
FLUSH_WORDS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of so many rows at most: whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder of spark.checkpoint.dir, which all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: spark.checkpoint.dir, or, in local mode only, one of this machine's."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "sylva-checkpoints"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles and checkpoints that nothing refers to any more, and the driver give back memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


class WordHash(dict):
    """word bytes -> unsigned 64-bit hash, kept for KEPT_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = h
        return h


HASHES = WordHash()


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words are runs without space and the controls 9 to 13; lower changes A to Z only. No text has no words."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive entries: doubling, so log k passes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        level, span, step, out, done = h, 1, MIX, None, 0
        while True:
            if k & span:
                part = level[k - done - span : k - done - span + n]
                out = part.copy() if out is None else out + part * power(done)
                done += span
            if done == k:
                return mixed(out)
            level = level[: len(level) - span] * step + level[span:]
            step, span = step * step, span * 2


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(MIX), n, 1 << 64))


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle; none gives none."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes_of(words)
    return np.unique(grams(h, min(k, len(h))) ^ np.uint64(min(k, len(h)) * 0x1F35))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows_of(batches: Iterator, *columns: str) -> Iterator[tuple]:
    """The named columns of each Arrow batch as Python lists."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
