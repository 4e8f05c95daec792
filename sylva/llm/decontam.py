"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted-shingle similarity.

Texts are lower-cased words of letters and digits. A window has as many k-word shingles as an item (fewer at a document's
end). Similarity weighs each shingle by its count: sum of the smaller counts / sum of the larger ones. Where that
reaches `least`, at least least * (n + m) / (1 + least) of a window's m shingles belong to the item of n shingles, and the
best window starts with one that does. So fingerprints are taken only of windows that start with a benchmark shingle and
hold enough of them; a bitmap of all benchmark shingles, which may say yes too often but never no, tells that in the
scan, and spares the 64 votes of all other windows. No window that could reach `least` is lost there.

Fingerprints have 64 bits. The index holds 8 blocks of 8 bits of each item, with all values of up to 2 errors, so each
pair within RADIUS = 8 * 2 + 7 = 23 bits meets (at a similarity of 0.8 the distance has mean 9.7 and deviation 2.9).
Window and item have the same length class, which is part of the key.

Defined results: null and empty texts, and items of fewer than k words, have no shingle and match nothing; repeated rows
of an id give one result; null ids are results like others; of equal windows the first counts; empty tables give none.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

BLOCKS, BLOCK_BITS, ERRORS = 8, 8, 2
RADIUS = BLOCKS * ERRORS + BLOCKS - 1
#: Bits of the bitmap for each benchmark shingle, and its largest size; a fuller one lets more windows through, no fewer.
BITS_EACH, MOST_BITS = 128, 1 << 23


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(rows: DataFrame, k: int) -> DataFrame:
    """Adds s, the hash of the k words from each position on; `words` is a column of its own, so that it is split once."""
    rows = once(rows, "words", words(F.col("text")))
    at = F.sequence(F.lit(0), F.size("words") - k)
    return once(rows, "s", F.when(F.size("words") >= k, F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))).drop("words")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: as a generator's output no filter or projection above repeats it."""
    return rows.withColumn(name, F.explode(F.array(value)))


def fingerprint(s: Column) -> Column:
    """64 majority votes. Four 16-bit counters share a long, or two 32-bit ones for more than 65,535 shingles."""
    return F.when(F.size(s) <= 0xFFFF, voted(s, 4)).otherwise(voted(s, 2))


def voted(s: Column, lanes: int) -> Column:
    wide = 64 // lanes
    ones = sum(1 << (wide * i) for i in range(lanes))
    counts = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda b: F.aggregate(s, F.lit(0).cast("long"), lambda n, h: n + shifted(h, b).bitwiseAND(F.lit(ones))))
    half, one, none = F.size(s), F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda c, b, lane: F.when(2 * shifted(c, F.lit(wide * lane)).bitwiseAND(F.lit((1 << wide) - 1)) > half, left(one, b + wide * lane)).otherwise(none)
    each = F.transform(counts, lambda c, b: functools.reduce(Column.bitwiseOR, [bit(c, b, lane) for lane in range(lanes)]))
    return F.aggregate(each, none, lambda a, x: a.bitwiseOR(x))


def shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def block(print_: Column, b: int) -> Column:
    return shifted(print_, F.lit(BLOCK_BITS * b)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def near_values() -> list[int]:
    """Differences of up to ERRORS bits of a block."""
    return [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= ERRORS]


def overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts. Without repeats that is the size of the intersection."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x))))


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity (6 decimals), start (in shingles, from 0) of the best window of each pair that reaches least."""
    bench = T.durable(shingled(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), k).where(F.size("s") > 0).select("item_id", F.col("s").alias("item"), F.size("s").alias("n"), fingerprint(F.col("s")).alias("item_print")))
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # distinct lengths only
    empty = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start")).limit(0)
    if not lengths:
        return empty
    each = bench.select(F.explode("item").alias("h"))
    size = min(MOST_BITS, 1 << max(12, (each.count() * BITS_EACH - 1).bit_length()))
    place = F.pmod(F.col("h"), F.lit(size))
    held = each.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(left(F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()  # MOST_BITS / 64 rows at most
    table = [0] * (size // 64)
    for r in held:
        table[r["word"]] = r["bits"]
    bitmap = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")  # a constant, folded once
    fewest = lambda n, m: math.ceil(least * (n + m) / (1 + least) - 1e-9)
    rows = shingled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), k)
    known = lambda h: F.call_function("getbit", F.get(bitmap, shifted(F.pmod(h, F.lit(size)), F.lit(6)).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1
    rows = once(rows, "hits", F.filter(F.transform("s", lambda h, i: F.when(known(h), i)), lambda i: i.isNotNull())).where(F.size("hits") >= fewest(lengths[0], 1))
    rows = rows.select("doc_id", "s", "hits").withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths])))
    # A window from hit i on holds enough hits if the hit that many further on lies inside it.
    inside = lambda start: F.least(F.col("n"), F.size("s") - start)
    need = lambda start: F.ceil((F.col("n") + inside(start)) * F.lit(least / (1 + least)) - 1e-9).cast("int")
    starts = F.filter(F.transform("hits", lambda p, i: F.when(F.get("hits", i + need(p) - 1) <= p + inside(p) - 1, p)), lambda p: p.isNotNull())
    rows = once(rows.withColumn("start", F.explode(starts)), "window", F.expr("slice(s, start + 1, n)")).select("doc_id", "n", "start", "window")
    rows = once(rows, "print", fingerprint(F.col("window")))
    index = bench.select("item_id", "item", "n", "item_print", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(F.col("item_print"), b).alias("v")) for b in range(BLOCKS)])).alias("x"))
    index = index.withColumn("v", F.explode(F.array(*[F.col("x.v").bitwiseXOR(F.lit(d)) for d in near_values()]))).select("item_id", "item", "n", "item_print", F.col("x.b").alias("b"), "v")
    probes = rows.withColumn("x", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), block(F.col("print"), b).alias("v")) for b in range(BLOCKS)]))).select("doc_id", "n", "start", "window", "print", F.col("x.b").alias("b"), F.col("x.v").alias("v"))
    near = probes.join(index, ["n", "b", "v"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # A pair meets in several blocks; the first of its agreeing blocks stands for all.
    first = F.lit(BLOCKS)
    for b in reversed(range(BLOCKS)):
        first = F.when(F.bit_count(block(F.col("print"), b).bitwiseXOR(block(F.col("item_print"), b))) <= ERRORS, F.lit(b)).otherwise(first)
    near = near.where(F.col("b") == first).where(F.array_contains("item", F.get("window", F.lit(0))))
    both = near.withColumn("o", overlap(F.col("window"), F.col("item")))
    both = both.withColumn("similarity", F.col("o") / (F.size("window") + F.col("n") - F.col("o"))).where(F.col("similarity") >= least - 1e-12)
    found = both.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("start").cast("int").alias("start"))
