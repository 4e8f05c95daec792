"""Substring dedup: removes words covered by a run that also starts earlier in the corpus.

A suffix is a position of the corpus's word sequence. All that matters of a suffix tree is whether a suffix lies below a
node at depth `window`, and which suffix below that node comes first: such a node is a repeat of `window` words, and runs
of them are the maximal repeats. So a suffix's prefix is taken at full depth at once, as a 64-bit fingerprint of `window`
words; suffixes are dealt by an independent fingerprint of the same prefix to groups that fit in memory, and each group sorts its
suffixes, which brings the leaves of each deep node together. A task sends a prefix on once only, with its first
place; later places in the task are repeats already. So a prefix that fills a third of the corpus reaches a group as
one entry from each task. Suffix positions travel packed in binary blocks, about 9 bytes each.

Defined results: null and empty texts have no words; a null doc_id comes before all others; rows with the same doc_id
and text are one document (each keeps the same words); rows with one doc_id and different texts are compared with each
other by their starts alone; other columns are kept by `deduplicated` as they are. No step compares the words: prefixes are
taken as equal if they fall into one group and have one fingerprint, which unequal ones do with a chance of about
pairs / (groups * 2 ** 64), and within one task's FLUSH_WORDS words with pairs / 2 ** 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Text bytes whose suffixes make a group.
GROUP_BYTES = 27 << 20
NO_ID = -(1 << 63)
#: Words that a task gathers before it hands their suffixes on; keys of documents that are sent to all workers (32 MB).
FLUSH_WORDS, MOST_SENT = 600_000, 2_000_000
#: Sets the words' hashes of the second fingerprint apart from those of the first.
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = "grp int, docs binary, bounds binary, keys binary, places binary, doc_id long, text_key long, starts binary"


def blocks(docs: DataFrame, window: int, groups: int) -> DataFrame:
    """Packed suffixes by group; with grp -1, the starts in a document that the task itself knows to be repeats."""
    T.bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.binary()]

    def handed(ids: list[tuple[int, int]], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bounds = np.r_[0, np.cumsum([len(p) for p in parts])]
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        keys = T.grams(words, window)
        other = T.grams(T.mixed(words ^ SECOND), window) >> np.uint64(33)
        at = np.arange(len(keys))
        owner = np.searchsorted(bounds, at, "right") - 1
        inside = at + window <= bounds[owner + 1]
        keys, other, at, owner = keys[inside], other[inside], at[inside], owner[inside]
        docs_, texts = (np.array([x[k] for x in ids], np.int64) for k in (0, 1))
        start = at - bounds[owner]
        order = np.lexsort((start, docs_[owner], keys))
        keys, other, at, owner, start = keys[order], other[order], at[order], owner[order], start[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        # Repeats within the task: places after the first, unless the very same document is given twice.
        lead = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else first
        late = ~first & ((docs_[owner] != docs_[owner[lead]]) | (start != start[lead]))
        rows = list(late_rows(docs_, texts, owner[late], start[late]))
        # Rows of one doc_id with other texts tie with the first place: they go on too.
        sent = first | ~late
        keys, at = keys[sent], at[sent]
        group = other[sent].astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        for g in range(groups):
            if cuts[g] < cuts[g + 1]:
                take = order[cuts[g] : cuts[g + 1]]
                take = take[np.argsort(at[take])]  # in order of place, so that the steps between places are small
                here = at[take]
                used = np.unique(np.searchsorted(bounds, here, "right") - 1)
                rows.append((g, np.stack([docs_[used], texts[used]]).tobytes(), bounds[used].astype("<u4").tobytes(), keys[take].tobytes(), narrow(np.diff(here, prepend=0)), 0, 0, None))  # ids of 0, since pandas makes floats of nulls
        for k in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0
        for docs_, keys_, texts in T.rows_of(batches, "doc_id", "text_key", "text"):
            for doc, key, text in zip(docs_, keys_, texts, strict=True):
                h = T.hashes_of(T.words_of(text))
                if len(h) >= window:
                    ids.append((doc, key))
                    parts.append(h)
                    size += len(h)
                if size >= FLUSH_WORDS:
                    yield from handed(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield from handed(ids, parts)

    return docs.mapInArrow(run, BLOCK)


def narrow(numbers: np.ndarray) -> bytes:
    """Byte planes, low bytes first, in as few planes as the largest number takes; planes of zeros compress away."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def widened(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros(((len(data) - 1) // width, 4), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return wide.view("<u4").ravel().astype(np.int64)


def late_rows(docs: np.ndarray, texts: np.ndarray, owner: np.ndarray, start: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(owner, kind="stable")
    owner, start = owner[order], start[order].astype("<u4")
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield -1, None, None, None, None, int(docs[owner[a]]), int(texts[owner[a]]), start[a:b].tobytes()


def repeats(docs: DataFrame, window: int) -> DataFrame:
    """doc_id and text_key (never null), starts: packed unsigned 32-bit starts of windows that also start earlier."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    groups = max(32, -(-size // GROUP_BYTES))
    names = ["doc_id", "text_key", "starts"]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        known, pdf = pdf[pdf["grp"] < 0], pdf[pdf["grp"] >= 0]
        if pdf.empty:
            return known[names]
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])
        docs_, texts, owner, start, base = [], [], [], [], 0
        for d, b, p in zip(pdf["docs"], pdf["bounds"], pdf["places"], strict=True):
            d, b = np.frombuffer(d, np.int64).reshape(2, -1), np.frombuffer(b, "<u4").astype(np.int64)
            here = np.cumsum(widened(p))
            place = np.searchsorted(b, here, "right") - 1
            offset = here - b[place]
            docs_.append(d[0])
            texts.append(d[1])
            owner.append((place + base).astype(np.int32))
            start.append(offset.astype(np.uint32))
            base += d.shape[1]
        docs_, texts, owner, start = map(np.concatenate, (docs_, texts, owner, start))
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        held = order[np.r_[False, same] | np.r_[same, False]]
        del order
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["keys"]])[held]
        owner, start = owner[held], start[held]
        order = np.lexsort((start, docs_[owner], keys))
        keys, owner, start = keys[order], owner[order], start[order]
        first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else first
        late = ~first & ((docs_[owner] != docs_[owner[lead]]) | (start != start[lead]))
        found = pd.DataFrame([x[5:] for x in late_rows(docs_, texts, owner[late], start[late].astype(np.int64))], columns=names)
        return pd.concat([x for x in (known[names], found) if len(x)]) if len(known) else found

    made = blocks(docs, window, groups)
    # The task's own repeats are not grouped, but dealt with the blocks, by their document.
    lane = F.when(F.col("grp") < 0, F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(groups))).otherwise(F.col("grp").cast("long"))
    return made.withColumn("lane", lane).groupBy("lane").applyInPandas(settle, "doc_id long, text_key long, starts binary")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.col("text").cast("string").alias("text"))


def kept(words: list[bytes], starts: list[bytes] | None, window: int) -> list[bytes]:
    if not starts:
        return words
    edge = np.zeros(len(words) + 1, np.int32)
    for block in starts:
        np.add.at(edge, at := np.frombuffer(block, "<u4"), 1)
        np.add.at(edge, at + window, -1)
    return [w for w, covered in zip(words, np.cumsum(edge[:-1]) > 0, strict=True) if not covered]


def marked(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, starts: a row per document that has repeats, all its blocks in a list."""
    found = T.durable(repeats(keyed(docs), window).groupBy("doc_id", "text_key").agg(F.collect_list("starts").alias("starts")))
    T.release(docs.sparkSession)  # the suffixes' shuffle is not needed any more
    return found


def joined(rows: DataFrame, found: DataFrame, doc: str, key: str, starts: str) -> DataFrame:
    """rows with their starts, null where a document has none. If the documents with repeats are at most MOST_SENT, their keys are
    sent to all workers, and only their rows travel to the starts; else all rows do."""
    told = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("starts").alias(starts))
    names = [*rows.columns, starts]
    if found.count() > MOST_SENT:
        return rows.join(told, [doc, key], "left").select(*names)
    keys = F.broadcast(told.select(doc, key))
    free = rows.join(keys, [doc, key], "left_anti").withColumn(starts, F.lit(None).cast("array<binary>"))
    return free.select(*names).union(rows.join(keys, [doc, key], "left_semi").join(told, [doc, key], "left").select(*names))


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, starts in T.rows_of(batches, "doc_id", "text", "starts"):
            out = []
            for doc, text, blocks_ in zip(ids, texts, starts, strict=True):
                words = T.words_of(text)
                left = kept(words, blocks_, window)
                out.append((None if doc == NO_ID else doc, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined(keyed(docs), marked(docs, window), "doc_id", "text_key", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int) -> DataFrame:
    """docs with the repeats taken out of text; a text without repeats stays as it is, white space included."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):  # names of our own that no column has
        mark += "_"
    doc, key, starts_ = f"{mark}doc", f"{mark}key", f"{mark}starts"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            starts = batch.column(batch.schema.get_field_index(starts_)).to_pylist()
            new = [t if not s else b" ".join(kept(T.words_of(t), s, window)).decode("utf-8", "surrogatepass") for t, s in zip(texts, starts, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).drop_columns([starts_])

    own = docs.withColumns({"text": F.col("text").cast("string"), doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return joined(own, marked(docs, window), doc, key, starts_).drop(doc, key).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
