"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends from the root to a region, a rack and a shard. At each level every child draws -ln(u) / weight, with u a
hash of the id and of the child's own name; the least draw wins, so children win in proportion to their weights. A draw
depends on nothing else: when a weight changes, rows move only from or to subtrees whose weights change. Growth opens a
region of its own for each new shard, so that one more shard takes rows only into itself.

Slots are gapless in each shard without a shard in one task: equal rows are counted first, a hash deals the rest to
PARTS parts of each shard, and the parts' counts (shards * PARTS numbers) give each part's first slot.

Defined results: a null text has 0 bytes and checksum 0; a null id is an id of its own; repeated rows go to one shard,
to consecutive slots; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256
#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]


def tree(shards: int, base: int = 40, regions: int = 2, racks: int = 5) -> Tree:
    """The first base shards, alike, in regions of racks; each further one is a region of its own."""
    out: Tree = {}
    for s in range(shards):
        each = -(-base // regions)
        region, rack = (s // each, s % each * racks // each) if s < base else (regions + s - base, 0)
        out.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return out


def hashed(text: Column, digits: int = 13) -> Column:
    """The first hex digits of md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def won(key: Column, children: Column) -> Column:
    """The child (name, weight, number) with the least draw; ties go to the smaller number."""
    u = lambda c: (hashed(F.concat(key, F.lit("/"), c["name"])) + F.lit(0.5)) / F.lit(float(16**13))
    return F.array_min(F.transform(children, lambda c: F.struct((-F.log(u(c)) / c["weight"]).alias("draw"), c["number"].alias("number"))))["number"]


def weight(node: dict | float) -> float:
    return sum(weight(x) for x in node.values()) if isinstance(node, dict) else float(node)


def level(nodes: dict[str, dict]) -> Column:
    """Parent's name -> its children, as a literal map of arrays."""
    child = lambda name, c, y: F.struct(F.lit(f"{name}/{c}").alias("name"), F.lit(weight(y)).alias("weight"), F.lit(c).alias("number"))
    return F.create_map(*[v for name, x in nodes.items() for v in (F.lit(name), F.array(*[child(name, c, y) for c, y in x.items()]))])


def descended(docs: DataFrame, key: Column, nodes: Tree, into: str) -> DataFrame:
    """Adds the shard of each row: region, rack, shard."""
    racks = {f"t/{r}": x for r, x in nodes.items()}
    shards = {f"t/{r}/{k}": y for r, x in nodes.items() for k, y in x.items()}
    for depth, children in enumerate(({"t": nodes}, racks, shards)):
        at = F.concat_ws("/", F.lit("t"), *[F.col(f"{into}_{d}").cast("string") for d in range(depth)])
        docs = docs.withColumn(f"{into}_{depth}", won(key, F.element_at(level(children), at)))
    return docs.withColumn(into, F.col(f"{into}_2").cast("int")).drop(*[f"{into}_{d}" for d in range(3)])


def shard(docs: DataFrame, nodes: Tree, grown: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    rows = descended(descended(rows, key, nodes, "shard"), key, grown, "grown_shard")
    rows = rows.withColumn("part", F.pmod(hashed(F.concat_ws("/", key, F.col("size").cast("string"), F.col("text_crc32").cast("string")), 6), F.lit(PARTS)))
    parts = rows.groupBy("shard", "part").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy("shard").orderBy("part")
    parts = parts.withColumn("first", F.sum("held").over(earlier) - F.col("held")).drop("held")
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    placed = rows.withColumn("before", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(parts), ["shard", "part"])  # shards * PARTS rows
    placed = placed.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("before"), F.col("first") + F.col("before") + F.col("n") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
