"""Exact top-k search by inner product, with candidates in buckets of equal length.

Each component x becomes floor(scale * x). Candidates are range-partitioned and sorted by length (Euclidean norm; ties by a
hash of the row), once; a bucket is a run of at most BUCKET vectors of such a partition, so a bucket's lengths are alike and
no tie makes a large one. Queries come to the candidates: blocks of at most BLOCK of them are broadcast (some 20 MB at
1,000 dimensions), candidates are never copied. The longest candidates are searched first, which gives each query a score that
its k-th best reaches at least; a task raises it further as it goes. From it a bucket has a local cosine threshold,
that score / (query length * bucket's longest): above 1 the bucket is left out. Else candidates are pruned by their own length
when the threshold is low, or, when it is high, by the coordinate in which the query is heaviest: a vector whose cosine
reaches t has there a share of at least q t - sqrt((1 - q^2)(1 - t^2)). What remains is verified by exact integer products:
in doubles while the lengths' product is below 2^53, in 64-bit integers below 2^63, beyond which an error is raised.

Pruning drops only what scores below the k-th best, never a tie: ties go to the smaller id.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of the
query's dimension are its candidates; a row with the query's own id is no candidate; repeated rows of an id are
candidates each, those of a query are one query (of different vectors under one id, the smallest); an empty table gives no
rows. Null ids take no part; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

BUCKET, BLOCK = 4096, 2048
SCALE = 1024.0
#: From this cosine threshold on, the heaviest coordinate prunes.
HIGH = 0.5


def integral(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, v (array of doubles that are whole numbers), norm."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.floor(e * F.lit(scale)).cast("double"))
    ok = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(ok)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))


def best(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller key."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((keys[some], -scores[some]))[:k]]
    return np.lexsort((keys, -scores))[:k]


class Asked:
    """A block of queries of one dimension, with the score that each one's k-th best reaches at least (-inf: unknown)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray):
        self.ids, self.vectors, self.floors = ids, vectors, floors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.heavy = np.abs(vectors).argmax(1)
        self.share = np.abs(vectors[np.arange(len(ids)), self.heavy]) / np.maximum(self.norms, 1e-300)


def products(c: np.ndarray, v: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; no partial sum is larger than bound, the product of the lengths."""
    if bound < float(1 << 53):
        return (c @ v).astype(np.int64)
    if bound < 2.0**63 * (1 - 1e-9):
        return c.astype(np.int64) @ v.astype(np.int64)
    raise ValueError("inner products beyond 64 bits: use a smaller scale")


def searched(asked: Asked, ids: np.ndarray, c: np.ndarray, norms: np.ndarray, k: int, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Merges a bucket (in falling length) into held: query's place -> its best ids and scores so far."""
    longest = float(norms[0])
    unit = c / np.maximum(norms, 1e-300)[:, None]
    for i, (qid, v, length) in enumerate(zip(asked.ids, asked.vectors, asked.norms, strict=True)):
        best, scores = held.get(i, (ids[:0], ids[:0]))
        floor = max(asked.floors[i], float(scores[-1]) if len(scores) >= k else -np.inf)
        live = np.arange(len(c))
        if floor > 0 and length > 0:
            cosine = floor / (length * max(longest, 1e-300))
            if cosine > 1 + 1e-9:
                continue
            # Length pruning: |c| |q| must reach the floor; the rows are in falling length.
            live = live[: np.searchsorted(-norms, -floor / length * (1 - 1e-9), "right")]
            if cosine > HIGH:
                share = asked.share[i]
                least = share * cosine - np.sqrt(max(0.0, (1 - share * share) * (1 - cosine * cosine)))
                if least > 0:
                    heavy = asked.heavy[i]
                    live = live[np.sign(v[heavy]) * unit[live, heavy] >= least - 1e-9]
        live = live[ids[live] != qid]
        got = products(c[live], v, float(length) * longest)
        ok = got >= floor if np.isfinite(floor) else np.ones(len(got), bool)
        if ok.any():
            all_ids, all_scores = np.r_[best, ids[live[ok]]], np.r_[scores, got[ok]]
            if len(all_ids) > 4 * k:
                edge = np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k]
                some = all_scores >= edge
                all_ids, all_scores = all_ids[some], all_scores[some]
            order = np.lexsort((all_ids, -all_scores))[:k]
            held[i] = all_ids[order], all_scores[order]


def search(rows: DataFrame, blocks: list[Asked], k: int) -> DataFrame:
    """query_id, vec_id, score: each task's k best for each query, of at least the query's floor."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = [{} for _ in shared.value]
        for batch in batches:
            ids, norms = batch.column("vec_id").to_numpy(), batch.column("norm").to_numpy()
            vectors = batch.column("v")
            sizes = vectors.value_lengths().to_numpy()
            flat, ends = vectors.flatten().to_numpy(), np.cumsum(sizes)
            for asked, found in zip(shared.value, held, strict=True):
                at = np.flatnonzero(sizes == asked.vectors.shape[1])
                if len(at):
                    at = at[np.argsort(-norms[at], kind="stable")]
                    searched(asked, ids[at], flat[(ends - sizes)[at][:, None] + np.arange(asked.vectors.shape[1])], norms[at], k, found)
        for asked, found in zip(shared.value, held, strict=True):
            if found:
                parts = [(np.full(len(i), asked.ids[q]), i, s) for q, (i, s) in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["query_id", "vec_id", "score"])

    return rows.select("vec_id", "v", "norm").mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_of(queries: DataFrame, number: int) -> list[Asked]:
    """A block's queries, at most some BLOCK rows, one Asked for each dimension."""
    got = queries.where(F.col("block") == number).select("vec_id", "v").toArrow()
    ids, vectors = got.column("vec_id").to_numpy(), got.column("v").to_pylist()
    sizes = np.array([len(v) for v in vectors])
    return [Asked(ids[at], np.array([vectors[i] for i in at]), np.full(len(at), -np.inf)) for d in np.unique(sizes).tolist() for at in [np.flatnonzero(sizes == d)]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = SCALE, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best among all other rows."""
    T.bounded_batches(vectors.sparkSession, bucket)
    rows = integral(vectors, scale).withColumn("salt", F.xxhash64("vec_id", "v"))
    rows = T.durable(rows.repartitionByRange(F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"), "salt"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // block))
    queries = T.durable(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")))
    first = rows.orderBy(F.desc("norm"), "salt").limit(bucket)  # the longest candidates
    found = None
    for number in range(blocks):
        asked = block_of(queries, number)
        # At most k rows a query come to the driver.
        least = {r.query_id: r.low for r in ranked(search(first, asked, k), k).groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
        for a in asked:
            a.floors = np.array([float(least.get(i, -np.inf)) for i in a.ids.tolist()])
        part = ranked(search(rows, asked, k), k)
        part = part if blocks == 1 else T.durable(part)
        found = part if found is None else found.union(part)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
