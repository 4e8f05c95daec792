"""Connected components of a table of links, in place: no link reaches the driver.

Each pass points every node at the neighbour (or itself) that a hash of the name ranks lowest, and draws the links again
between what their ends point at. Under a random rank a constant share of the nodes goes in each pass, so the passes grow
with the logarithm of the nodes, on a path as well. A node's neighbours are met in a minimum, which is combined before
the shuffle; where rows look a node up, a small table is broadcast and a large one is met in salted parts, so a node with
a third of the links is not one task's work. Once no more than ONE_TASK links are left, between components by then, one task
joins them: each pass over few rows costs the driver a plan and the executors a task for every partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: A table of at most so many rows of two longs is broadcast (some 3 MB); a larger one is shuffled in SALTS parts a node.
FEW, SALTS = 100_000, 16
#: Links that one task joins (8 MB).
ONE_TASK = 500_000


def looked_up(rows: DataFrame, column: str, table: DataFrame, few: bool) -> DataFrame:
    """rows with column replaced by its root in table (node, root); nodes that the table leaves out stay."""
    names = rows.columns
    if few:
        met = rows.join(F.broadcast(table.select(F.col("node").alias("_n"), F.col("root").alias("_r"))), rows[column] == F.col("_n"), "left")
    else:
        salted = table.select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_t"))
        rows = rows.withColumn("_s", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int"))
        met = rows.join(salted, (rows[column] == F.col("_n")) & (F.col("_s") == F.col("_t")), "left")
    return met.withColumn(column, F.coalesce("_r", column)).select(*names)


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a - b, and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (a, b) of a task."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if held:
        node, root = least_roots(*(np.concatenate(c) for c in zip(*held, strict=True)))
        for at in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 100_000]), pa.array(root[at : at + 100_000])], ["node", "root"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node reachable.

    Null ends are dropped; a link of a node with itself says nothing; no links give no rows; repeated links count once.
    """
    edges = T.durable(links.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    found = None
    while True:
        left = edges.count()
        if left <= ONE_TASK:
            step = T.durable(edges.coalesce(1).mapInArrow(joined, "node long, root long"))
            if found is None:
                return step
            found = T.durable(looked_up(found, "root", step, 2 * left <= few))
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        step = T.durable(ranked.select(F.col("a").alias("node"), F.least(own, F.col("m"))["b"].alias("root")))
        small = step.count() <= few
        found = step if found is None else T.durable(looked_up(found, "root", step, small))
        drawn = looked_up(looked_up(edges, "a", step, small), "b", step, small).where("a <> b")
        edges = T.durable(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        T.release(links.sparkSession)
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return looked_up(found, "root", least.select(F.col("root").alias("node"), F.col("least").alias("root")), found.count() <= few)
