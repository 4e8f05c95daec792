"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; pieces are dealt by a hash to cells of about CELL pieces, so that the work grows in
proportion. Each cell is evolved by several islands: a crossover injects whole well-filled bins of one parent into the
other, removes the bins that hold the same pieces, and best-fits the displaced ones in falling order. Between epochs the
best packing of an island moves to the next island of its cell. The first parent is best-fit decreasing and the best is
never lost, so a cell is never packed worse than that.

Defined results: a null text is empty and gives one piece, the end id alone; repeated rows and repeated or null ids are
packed row by row; other columns of the input are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import tokens

CELL, ISLANDS, EPOCHS, GENERATIONS, PARENTS = 4096, 2, 2, 6, 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 0) -> DataFrame:
    """One row per piece: ids of the whole text, then end_id; only longer documents are cut, every capacity ids."""
    T.bounded_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(tokenizer)
        for ids, texts in T.rows_of(batches, "doc_id", "text"):
            out: list[tuple] = []
            for doc, text in zip(ids, texts, strict=True):
                data = code.encode(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(order: list[int], sizes: list[int], capacity: int, bin_of: np.ndarray, room: dict[int, int], first_new: int) -> None:
    """Puts the items of order into the fullest bin that takes them, else into a new one. room: bin -> room left."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, r in room.items():
        free[r].append(b)
        mask |= 1 << r
    for i in order:
        size = sizes[i]
        left = mask >> size
        if left:
            r = size + (left & -left).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b, first_new = capacity, first_new, first_new + 1
        bin_of[i] = b
        free[r - size].append(b)
        mask |= 1 << (r - size)


def fitness(bin_of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """More is better: fewer bins, then the mean square of their fill."""
    fill = np.bincount(bin_of, sizes)
    fill = fill[fill > 0] / capacity
    return -len(fill), float((fill * fill).mean()) if len(fill) else 0.0


def crossed(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, listed: list[int], capacity: int, rng: random.Random) -> np.ndarray:
    """Child of a with whole well-filled bins of b."""
    fill = np.bincount(b, sizes)
    best = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.sample(best.tolist(), max(1, len(best) // 3))] = True
    given = chosen[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[given]] = True
    child = a.copy()
    loose = broken[a] & ~given
    names, packed = np.unique(b[given], return_inverse=True)
    start = len(broken)
    child[given] = start + packed
    load = np.bincount(child[~loose], sizes[~loose], minlength=start + len(names))
    room = {int(x): capacity - int(load[x]) for x in np.flatnonzero((load > 0) & (load < capacity))}
    order = np.flatnonzero(loose)
    best_fit(order[np.argsort(-sizes[order], kind="stable")].tolist(), listed, capacity, child, room, start + len(names))
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def evolved(parents: list[np.ndarray], sizes: np.ndarray, capacity: int, generations: int, seed: int) -> list[np.ndarray]:
    """The fittest first; as many as came in. A packing as good as the volume allows ends the search."""
    rng, listed, least = random.Random(seed), sizes.tolist(), -(-int(sizes.sum()) // capacity)
    ranked = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(parents)), reverse=True, key=lambda x: x[:2])
    for g in range(generations):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = rng.sample(ranked, 2)
        for x, y in ((a, b), (b, a)):
            child = crossed(x[2], y[2], sizes, listed, capacity, rng)
            ranked.append((fitness(child, sizes, capacity), -g, child))
        ranked = sorted(ranked, reverse=True, key=lambda x: x[:2])[: len(parents)]
    return [p for _, _, p in ranked]


def founders(sizes: np.ndarray, capacity: int, count: int, seed: int) -> list[np.ndarray]:
    """Best-fit decreasing, then best-fit over disturbed orders."""
    rng, out = np.random.default_rng(seed), []
    for k in range(count):
        noise = sizes * (1 + (0.02 * k + 0.05 * (seed % 7) * (k > 0)) * rng.random(len(sizes)))
        packed = np.zeros(len(sizes), np.int32)
        best_fit(np.argsort(-noise, kind="stable").tolist(), sizes.tolist(), capacity, packed, {}, 0)
        out.append(packed)
    return out


ISLAND = "cell long, island int, uids binary, sizes binary, packings binary, elite binary, bins long, fill double"


def pack(docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 0, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, parents: int = PARENTS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    whole = T.durable(pieces(docs, capacity, tokenizer, end_id).withColumn("uid", F.monotonically_increasing_id()))
    loose = whole.where(F.col("length") < capacity)
    cells = max(1, -(-loose.count() // cell))

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        sizes = pdf["length"].to_numpy(np.int32)
        rows = []
        for i in range(islands):
            best = evolved(founders(sizes, capacity, parents, i), sizes, capacity, generations, 31 * i)
            rows.append(row(key[0], i, pdf["uid"].to_numpy(np.int64).tobytes(), sizes, best, capacity))
        return pd.DataFrame(rows, columns=NAMES)

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for x in pdf.itertuples():
                sizes = np.frombuffer(x.sizes, np.int32)
                own = list(np.frombuffer(x.packings, np.int32).reshape(-1, len(sizes)))
                if x.guest is not None:
                    own[-1] = np.frombuffer(x.guest, np.int32)
                best = evolved(own, sizes, capacity, generations, 31 * x.island + x.epoch)
                rows.append(row(x.cell, x.island, x.uids, sizes, best, capacity))
            yield pd.DataFrame(rows, columns=NAMES)

    state = loose.select((F.pmod(F.xxhash64("uid"), F.lit(cells))).alias("cell"), "uid", "length").groupBy("cell").applyInPandas(settle, ISLAND)
    for epoch in range(1, epochs):
        state = T.durable(state)
        guests = state.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
        state = state.join(guests, ["cell", "island"], "left").withColumn("epoch", F.lit(epoch)).mapInPandas(again, ISLAND)
    best = state.groupBy("cell").agg(F.max_by(F.struct("uids", "sizes", "elite"), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("x")).select("cell", "x.*")

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for x in pdf.itertuples():
                sizes, bin_of = np.frombuffer(x.sizes, np.int32).astype(np.int64), np.frombuffer(x.elite, np.int32).astype(np.int64)
                order = np.argsort(bin_of, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.r_[True, bin_of[order][1:] != bin_of[order][:-1]]
                starts = ends - sizes[order]
                offset = starts - np.maximum.accumulate(np.where(first, starts, 0))
                yield pd.DataFrame({"uid": np.frombuffer(x.uids, np.int64)[order], "sequence_id": 2 * (x.cell * (1 << 32) + bin_of[order]), "offset": offset})

    placed = best.mapInPandas(places, "uid long, sequence_id long, offset long")
    full = whole.where(F.col("length") == capacity).withColumns({"sequence_id": 2 * F.col("uid") + 1, "offset": F.lit(0).cast("long")})
    return loose.join(placed, "uid").unionByName(full).drop("uid")


NAMES = ["cell", "island", "uids", "sizes", "packings", "elite", "bins", "fill"]


def row(cell: int, island: int, uids: bytes, sizes: np.ndarray, best: list[np.ndarray], capacity: int) -> tuple:
    bins, fill = fitness(best[0], sizes, capacity)
    return cell, island, uids, sizes.tobytes(), np.concatenate(best).astype(np.int32).tobytes(), best[0].astype(np.int32).tobytes(), -bins, fill
