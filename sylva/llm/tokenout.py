"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride binary shards.

Each document is encoded whole, ended by end_id and cut into sequences of at most length ids. A sequence's number is made of
its document's id, a hash of its text and its piece, so it depends on the corpus alone, not on how it was scanned. The number
goes through a keyed Feistel permutation with cycle-walking. The permuted numbers, split into equal ranges, say its
shard, and their order within the range its place there; a global slot is the shard's first slot plus that place. So the
order is a function of the key and the corpus, one encoding and one shuffle suffice, and slots become gapless from the
shards' own record counts: a slot is the rank of the permuted number. Dense numbers, whose image would be the slot
itself, need all sequences counted before the first is placed: a second copy of them on disk.

A record is a header (doc_id int64, piece int32, count int32) and length ids, padded with pad_id; ids take two bytes when
the vocabulary allows. Reading can resume at any slot by seeking to place * stride. Files get their names only when
complete, so that a task run twice leaves the same file.

Defined results: a null text is empty and gives one sequence, end_id alone; a null doc_id is stored as the least int64
and read back as null; repeated rows of one id and text have one number and follow each other, alike; an empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from . import tokens

HEADER, HEADER_BYTES = "<qii", 16
NO_ID = -(1 << 63)
#: Text bytes of a shard; bits of a sequence's number.
SHARD_BYTES, NUMBER_BITS = 24 << 20, 61


def feistel(x: Column, bits: int, key: str, rounds: int = 4) -> Column:
    """A permutation of the numbers below 2 ** bits by keyed hashes of one part. rounds is even: the parts change places."""
    high, low = bits // 2, bits - bits // 2
    left, right = F.shiftright(x, low), x.bitwiseAND(F.lit((1 << low) - 1))
    for r in range(rounds):
        salt = int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:7], "little")
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(salt)).bitwiseAND(F.lit((1 << high) - 1)))
        high, low = low, high
    return F.shiftleft(left, low).bitwiseOR(right)


def permuted(df: DataFrame, column: str, into: str, size: int, key: str) -> DataFrame:
    """Adds the permuted place, below size, of column's values, all below size.

    The permutation acts on the next power of two; a value that leaves the range is permuted again until it is back
    inside (cycle-walking). At least half of the values are inside, so few rows reach the long walk.
    """
    bits = max(2, (size - 1).bit_length())
    step = lambda v: F.when(v < size, v).otherwise(feistel(v, bits, key))
    df = df.withColumn(into, feistel(F.col(column).cast("long"), bits, key))
    for _ in range(4):
        df = df.withColumn(into, step(F.col(into)))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(256)), F.col(into), lambda v, _: step(v))
    df = df.withColumn(into, F.when(F.col(into) < size, F.col(into)).otherwise(walk))
    return df.withColumn(into, F.when(F.col(into) < size, F.col(into)).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long")))


def sequences(docs: DataFrame, length: int, tokenizer: str, end_id: int, wide: bool) -> DataFrame:
    """doc_id, text_key (a hash of the text), piece, count, ids (binary)."""
    T.bounded_batches(docs.sparkSession)
    end, width = np.array([end_id], "<u4").tobytes(), 4 if wide else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(tokenizer)
        for ids, keys, texts in T.rows_of(batches, "doc_id", "text_key", "text"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text_key, text in zip(ids, keys, texts, strict=True):
                data = np.frombuffer(code.encode(text) + end, "<u4").astype("<u4" if wide else "<u2").tobytes()
                for k, at in enumerate(range(0, len(data), width * length)):
                    part = data[at : at + width * length]
                    for column, value in zip(out, (doc, text_key, k, len(part) // width, part), strict=True):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "text_key", "piece", "count", "ids"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, piece int, count int, ids binary")


def write(docs: DataFrame, out: str, length: int, tokenizer: str, key: str, end_id: int = 0, pad_id: int = 0, vocabulary: int = 49_408, least_shards: int = 16) -> DataFrame:
    """Writes the shards below out, a folder that all executors share; returns the manifest: shard, path, records, first_slot, stride, length, width."""
    wide = vocabulary > 1 << 16
    width = 4 if wide else 2
    stride = HEADER_BYTES + width * length
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    told = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long") + 16), F.lit(0)).alias("size"), F.coalesce(F.max(F.octet_length(text)), F.lit(0)).alias("longest"), F.min(id_).alias("low"), F.max(id_).alias("high")).first()
    shards = max(least_shards, -(-told["size"] // SHARD_BYTES))
    # Ids take the bits of their range (null follows the largest), pieces those of the longest text (a token has a byte at least), and
    # the text's hash what is left of NUMBER_BITS.
    low, span = (0, 1) if told["low"] is None else (told["low"], told["high"] - told["low"] + 2)
    pieces = max(1, ((told["longest"] + 1) // length).bit_length())
    spare = NUMBER_BITS - (span - 1).bit_length() - pieces
    if spare < 0:
        raise ValueError("ids are too far apart to number their sequences")
    document = F.when(F.col("doc_id").isNull(), F.lit(span - 1)).otherwise(F.col("doc_id") - F.lit(low))
    numbers = span << (spare + pieces)
    rows = sequences(docs, length, tokenizer, end_id, wide).withColumn("n", F.shiftleft(document.cast("long"), spare + pieces).bitwiseOR(F.shiftleft(F.shiftrightunsigned("text_key", 64 - spare) if spare else F.lit(0).cast("long"), pieces)).bitwiseOR(F.col("piece").cast("long")))
    rows = permuted(rows, "n", "place", numbers, key)
    rows = rows.withColumn("shard", F.least(F.floor(F.col("place") / F.lit(float(numbers)) * shards), F.lit(shards - 1)).cast("int"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "ids").select("shard", "doc_id", "piece", "count", "ids")
    pad = np.array([pad_id], "<u4" if wide else "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out)
        store.create_dir(base, recursive=True)
        now, sink, name, count = None, None, "", 0
        done: list[tuple] = []

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(name, f"{base}/shard-{now:06d}.bin")
                done.append((now, f"shard-{now:06d}.bin", count))

        for shard_, doc_, piece_, count_, ids_ in T.rows_of(batches, "shard", "doc_id", "piece", "count", "ids"):
            for shard, doc, piece, n, ids in zip(shard_, doc_, piece_, count_, ids_, strict=True):
                if shard != now:
                    close()
                    now, name, count = shard, f"{base}/.part-{shard:06d}-{uuid.uuid4().hex}", 0
                    sink = store.open_output_stream(name, buffer_size=1 << 20)
                sink.write(struct.pack(HEADER, NO_ID if doc is None else doc, piece, n) + ids + pad * (length - n))
                count += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], ["shard", "path", "records"])

    listed = T.durable(rows.mapInArrow(run, "shard int, path string, records long"))
    total = F.sum("records").over(Window.orderBy("shard"))  # a row per shard
    return listed.withColumn("first_slot", total - F.col("records")).withColumns({"stride": F.lit(stride), "length": F.lit(length), "width": F.lit(width)})


def read(spark: SparkSession, manifest: DataFrame, out: str, from_slot: int = 0) -> DataFrame:
    """doc_id, piece, slot, shard, place, length, ids_crc32 (of the ids as unsigned 32-bit) of the records from a slot on, read sequentially."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out)
        for batch in batches:
            for x in batch.to_pylist():
                skip = max(0, from_slot - x["first_slot"])
                with store.open_input_file(f"{base}/{x['path']}") as f:
                    for at in range(skip, x["records"], 8192):
                        n = min(8192, x["records"] - at)
                        f.seek(at * x["stride"])
                        data = f.read(n * x["stride"])
                        heads = np.ndarray((n,), np.dtype([("doc", "<i8"), ("piece", "<i4"), ("count", "<i4")]), data, 0, (x["stride"],))
                        ids = np.ndarray((n, x["length"]), f"<u{x['width']}", data, HEADER_BYTES, (x["stride"], x["width"])).astype("<u4")
                        crc = [zlib.crc32(row[:c].tobytes()) for row, c in zip(ids, heads["count"], strict=True)]
                        doc = heads["doc"].copy()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc, mask=doc == NO_ID), pa.array(heads["piece"].copy()), pa.array(x["first_slot"] + np.arange(at, at + n)), pa.array(np.full(n, x["shard"], np.int32)), pa.array(np.arange(at, at + n)), pa.array(heads["count"].astype(np.int64)), pa.array(crc, pa.int64())],
                            ["doc_id", "piece", "slot", "shard", "place", "length", "ids_crc32"],
                        )

    files = manifest.where(F.col("first_slot") + F.col("records") > from_slot).repartition(max(1, manifest.count()), "shard")
    return files.mapInArrow(run, "doc_id long, piece int, slot long, shard int, place long, length long, ids_crc32 long")
