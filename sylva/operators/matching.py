"""Trees against reference trees: pairs within a distance, greedy one-to-one matches, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(found: DataFrame, reference: DataFrame, reach: float = 2.0) -> DataFrame:
    """tree_id, ref_id, d of all pairs within reach: each reference stands in the 9 buckets around its own."""
    f = found.select("tree_id", F.col("x").alias("fx"), F.col("y").alias("fy"), F.floor(F.col("x") / reach).alias("bx"), F.floor(F.col("y") / reach).alias("by"))
    around = F.explode(F.array(*[F.struct((F.floor(F.col("x") / reach) + a).alias("bx"), (F.floor(F.col("y") / reach) + b).alias("by")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("k")
    r = reference.select("ref_id", "x", "y", around).select("ref_id", "x", "y", "k.bx", "k.by")
    d = F.sqrt((F.col("fx") - F.col("x")) * (F.col("fx") - F.col("x")) + (F.col("fy") - F.col("y")) * (F.col("fy") - F.col("y")))
    return f.join(r, ["bx", "by"]).select("tree_id", "ref_id", d.alias("d")).where(F.col("d") <= reach)


def greedy(pairs: DataFrame, durable=lambda df: df) -> DataFrame:  # noqa: ANN001
    """One-to-one matches by ascending (d, tree_id, ref_id): rounds of mutually nearest pairs, which gives the same matches."""
    out, order = None, F.struct("d", "tree_id", "ref_id")
    while True:
        by_tree = pairs.groupBy("tree_id").agg(F.min(order).alias("b")).select("b.*")
        by_ref = pairs.groupBy("ref_id").agg(F.min(order).alias("b")).select("b.*")
        taken = durable(by_tree.join(by_ref, ["d", "tree_id", "ref_id"]))
        if taken.isEmpty():
            return out if out is not None else taken.select("tree_id", "ref_id", "d")
        out = taken.select("tree_id", "ref_id", "d") if out is None else out.union(taken.select("tree_id", "ref_id", "d"))
        pairs = durable(pairs.join(taken.select("tree_id"), "tree_id", "left_anti").join(taken.select("ref_id"), "ref_id", "left_anti"))


def scores(matched: DataFrame, found: DataFrame, reference: DataFrame) -> DataFrame:
    """n_found, n_ref, n_matched, recall, precision, f1, median_d."""
    m = matched.agg(F.count("*").alias("n_matched"), F.percentile("d", F.lit(0.5)).alias("median_d"))
    counts = found.agg(F.count("*").alias("n_found")).join(reference.agg(F.count("*").alias("n_ref"))).join(m)  # one row each
    recall, precision = F.col("n_matched") / F.col("n_ref"), F.col("n_matched") / F.col("n_found")
    return counts.select("n_found", "n_ref", "n_matched", F.bround(recall, 3).alias("recall"), F.bround(precision, 3).alias("precision"), F.bround(2 * recall * precision / (recall + precision), 3).alias("f1"), F.round("median_d", 6).alias("median_d"))
