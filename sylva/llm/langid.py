"""Language ID by prediction by partial matching over bytes.

A language's statistics are a variable-order context tree: how often each byte follows each context of 0 to ORDER bytes.
A context reaches back to the start of its word at most (a space stands there), so a word has one exact code length in a
language, wherever it is. A byte is coded at its longest known context with the counts of method C: count / (n + d) for
a byte seen there, else an escape of d / (n + d) and the next shorter context; below order 0 all 256 bytes are alike.
Statistics are frozen: reading a text changes nothing. The language of the least code length wins; the score is its
share of 2 ** -length over the languages.

Statistics come from about MAX_ROWS documents of each language (chosen by a hash of the id, at a rate that the counts of
documents give), which bounds the trees and what is broadcast. Texts are lower-cased and scored whole.

Defined results: a null text or one without a letter is 'und' with score 0; rows with a null lang teach nothing; ties go
to the first language in order; with nothing learnt all texts are 'und'; repeated rows count and are scored each.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

MAX_ROWS, ORDER, KEPT_WORDS = 1000, 4, 400_000


class Trees:
    """Code lengths in bits, by language, of every context and byte that any language has seen."""

    def __init__(self, counts: dict[str, dict[bytes, int]]):
        """counts: language -> context followed by byte -> times."""
        self.languages = sorted(counts)
        n = len(self.languages)
        seen = [np.zeros((0, n))] * (ORDER + 1)
        self.codes: list[np.ndarray] = []
        for k in range(ORDER + 1):
            grams = sorted({g for c in counts.values() for g in c if len(g) == k + 1})
            self.codes.append(np.array([code(g) for g in grams], np.uint64))
            seen[k] = np.array([[counts[x].get(g, 0) for x in self.languages] for g in grams], float).reshape(len(grams), n)
        self.bits, self.contexts, self.escapes = [], [], []
        lower = np.full((1, n), 8.0)
        for k in range(ORDER + 1):
            context, back = np.unique(self.codes[k] >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, back, seen[k])
            np.add.at(kinds, back, seen[k] > 0)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1e-300) / np.maximum(total + kinds, 1e-300)), 0.0)
            short = self.codes[k] & np.uint64((1 << 8 * k) - 1)
            below = lower if k == 0 else self.bits[k - 1][np.searchsorted(self.codes[k - 1], short)]
            direct = -np.log2(np.maximum(seen[k], 1e-300) / np.maximum((total + kinds)[back], 1e-300))
            self.bits.append(np.where(seen[k] > 0, direct, escape[back] + below))
            self.contexts.append(context)
            self.escapes.append(escape)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word and the space after it, by language."""
        data = np.frombuffer(b"".join(b" " + w for w in words) + b" ", np.uint8).astype(np.uint64)
        sizes = np.array([len(w) + 1 for w in words])
        at = np.arange(1, len(data))
        depth = np.concatenate([np.arange(1, s + 1) for s in sizes])  # bytes back to the space before the word
        bits = np.full((len(at), len(self.languages)), 8.0)
        gram = data[1:].copy()
        context = np.zeros(len(at), np.uint64)
        for k in range(ORDER + 1):
            live = np.flatnonzero(depth >= k)
            if k:
                earlier = data[at[live] - k]
                context[live] |= earlier << np.uint64(8 * (k - 1))
                gram[live] |= earlier << np.uint64(8 * k)
            if not len(self.codes[k]):
                break
            place = np.minimum(np.searchsorted(self.codes[k], gram[live]), len(self.codes[k]) - 1)
            hit = self.codes[k][place] == gram[live]
            place_c = np.minimum(np.searchsorted(self.contexts[k], context[live]), len(self.contexts[k]) - 1)
            known = ~hit & (self.contexts[k][place_c] == context[live])
            bits[live[known]] += self.escapes[k][place_c[known]]
            bits[live[hit]] = self.bits[k][place[hit]]
        return np.add.reduceat(bits, np.r_[0, np.cumsum(sizes)[:-1]])


def has_letter(text: str | None) -> bool:
    """A character of a Unicode letter category; digits in circles, fractions and Roman numeral signs are none."""
    return any(map(str.isalpha, text or ""))


def code(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


def grams_of(word: bytes) -> Iterator[bytes]:
    padded = b" " + word + b" "
    for i in range(1, len(padded)):
        for k in range(min(ORDER, i) + 1):
            yield padded[i - k : i + 1]


def pieces(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split() if text else []


def fit(docs: DataFrame, usable: Column, max_rows: int = MAX_ROWS) -> Trees:
    T.bounded_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(usable)
    rates = {x.lang: max_rows / x.n for x in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("lang")) if rates else F.lit(0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for langs, texts in T.rows_of(batches, "lang", "text"):
            for lang, text in zip(langs, texts, strict=True):
                words.setdefault(lang, Counter()).update(pieces(text))
        for lang, count in words.items():
            grams: Counter = Counter()
            for word, n in count.items():
                for g in grams_of(word):
                    grams[g] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.keys(), pa.binary()), pa.array(grams.values(), pa.int64())], ["lang", "gram", "n"])

    counted = known.where(draw < rate).select("lang", "text").mapInArrow(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {}
    for x in counted.toLocalIterator():
        counts.setdefault(x.lang, {})[bytes(x.gram)] = x.n
    return Trees(counts)


_kept: dict[str, tuple[dict[bytes, int], list]] = {}


def word_rows(trees: Trees, key: str, words: list[list[bytes]]) -> np.ndarray:
    """A row of code lengths for each word. A worker keeps those of KEPT_WORDS words."""
    if key not in _kept:
        _kept.clear()  # a worker outlives a query; an earlier model's words are of no use
    index, table = _kept.setdefault(key, ({}, [np.empty((0, len(trees.languages)))]))
    new = list({w for x in words for w in x if w not in index})
    more = {w: len(index) + i for i, w in enumerate(new)}
    if new:
        fresh = np.concatenate([trees.lengths(new[i : i + 20_000]) for i in range(0, len(new), 20_000)])
        rows = np.concatenate([table[0], fresh])
    else:
        rows = table[0]
    if len(index) + len(new) <= KEPT_WORDS:
        index.update(more)
        table[0] = rows
        more = {}
    get, other = index.get, more.get
    return rows[np.fromiter((i if (i := get(w)) is not None else other(w) for x in words for w in x), np.int64)]


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    T.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, texts in T.rows_of(batches, "doc_id", "text"):
            if not ids:
                continue
            und = np.array([not has_letter(t) for t in texts]) | (not model.languages)
            words = [[] if u else pieces(t) for t, u in zip(texts, und, strict=True)]
            names, scores = ["und"] * len(ids), np.zeros(len(ids))
            sizes = np.array([len(w) for w in words])
            if sizes.sum():
                rows = word_rows(model, key, words)
                full = np.flatnonzero(sizes)
                bits = np.add.reduceat(rows, np.r_[0, np.cumsum(sizes[full])[:-1]])
                share = np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000))
                scores[full] = 1 / share.sum(1)
                for i, best in zip(full, bits.argmin(1), strict=True):
                    names[i] = model.languages[best]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
