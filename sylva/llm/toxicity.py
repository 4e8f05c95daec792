"""Toxicity by class-conditional Kneser-Ney models.

Two word-bigram models, of toxic and of ordinary texts, with absolute discounting and interpolated backoff:

    P_c(w | h) = (max(c_c(h, w) - D_c, 0) + t_c(h) * P_c(w)) / c_c(h)
    P_c(w)     = (max(n_c(w) - E_c, 0) + T_c * P(w)) / N_c

c counts the documents with a pair of words, n a word's kinds of predecessors (Kneser-Ney's continuation counts) with the sum
N; t and T are what the discounts take away. P comes from the continuation counts that both classes share (discounted by
DISCOUNT for all words alike): what a class's discount takes goes to them, so a rare expression is judged by what the
classes have in common. The absolute discounts D and E hold for the class with fewer counts; the other class's are those
that take the same share of its counts, else a class's size alone would speak in every rare word. All sum to 1.

A text's feature is the greatest difference of the two log-likelihoods, normalised by length, over its passages of `span`
words (the whole text where it is shorter): a long text is as toxic as its most toxic passage. A logistic curve turns it
into a score. D, E and span are those of PAIR_DISCOUNTS, WORD_DISCOUNTS and SPANS with the least log-loss on CURVE_FOLDS fifths of
the labelled texts that may be learnt from; these fit the curve and take no part in the counts.

Labels come from at most MAX_ROWS labelled documents (the first in the order of a hash of the id): that bounds the
models and what is broadcast. Every text is scored whole. Every word and every bigram of the counted documents counts in the
models, however rare.

Defined results: null and empty texts have no words and the feature 0; what holds no character but punctuation is no word; words
outside the models count as one unknown word, alike in both classes; repeated rows are scored each; labels that are null or
of unknown documents are not used, of several labels of an id the largest holds; without labels of both classes every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

MAX_ROWS = 12_000
#: The discount of the shared counts; those of the classes and the passages' words that are tried.
DISCOUNT = 0.75
WORD_DISCOUNTS, PAIR_DISCOUNTS, SPANS = (2.0, 5.0, 12.0), (1.0, 4.0, 16.0), (1, 2, 4, 16)
#: Share of the labelled documents, in fifths, that fit the curve and not the counts.
CURVE_FOLDS = 2


def word_list(text: str | None) -> list[str]:
    return [x for w in text.lower().split() if (x := w.strip(".,;:!?\"'()"))] if text else []


def discounts(counts: np.ndarray, discount: float, times: np.ndarray | None = None) -> np.ndarray:
    """Of both classes (the columns): discount for the one with fewer counts, and what takes the same share of the other's.
    times: how often each row of counts occurs."""
    times = np.ones(len(counts), np.int64) if times is None else times
    total = (counts * times[:, None]).sum(0)
    if not total.min():
        return np.array([discount, discount])
    few = int(total[1] < total[0])
    own, other = counts[:, few], counts[:, 1 - few]
    share = (np.minimum(own, discount) * times).sum() / total[few]
    kinds, back = np.unique(other, return_inverse=True)
    often = np.bincount(back, times)
    low, high = 0.0, float(kinds.max())
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (np.minimum(kinds, middle) * often).sum() < share * total[1 - few] else (low, middle)
    return np.array([high, discount] if few else [discount, high])


class Model:
    """Counts and what follows from them, as arrays. Word 0 is unknown, 1 stands before the first word.

    Only counts are sent to the workers, compressed. Of the bigrams only those are held that the least discount leaves something of;
    the others, most of them of one document, have no part of their own in any probability."""

    def __init__(self, words: bytes, counts: np.ndarray, codes: np.ndarray, summed: np.ndarray, taken: dict[float, np.ndarray] | None = None):
        """words: a line each, their places are from 2; counts by place: continuation counts toxic and ordinary, counts as a
        history toxic and ordinary; codes: history's place * size + word's place, ascending; summed: their counts toxic and ordinary;
        taken: the discounts of all bigrams in both classes (by default those of the bigrams given)."""
        self.words, self.counts, self.codes, self.summed, self.taken = words, counts, codes, summed, taken or {}
        self.size = len(counts)
        self.chosen, self.curve = (WORD_DISCOUNTS[0], PAIR_DISCOUNTS[0], SPANS[0]), (0.0, -50.0)
        self.index: dict[str, int] | None = None
        self.lower: dict[float, np.ndarray] = {}
        self.direct: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> tuple:
        pack = lambda x, kind: zlib.compress(np.ascontiguousarray(x, kind), 1)
        return zlib.compress(self.words, 1), pack(self.counts, "<i4"), pack(np.diff(self.codes, prepend=0), "<i8"), pack(self.summed, "<i4"), self.taken, self.chosen, self.curve

    def __setstate__(self, state: tuple) -> None:
        words, counts, codes, summed = map(zlib.decompress, state[:4])
        self.__init__(words, np.frombuffer(counts, "<i4").reshape(-1, 4), np.cumsum(np.frombuffer(codes, "<i8")), np.frombuffer(summed, "<i4").reshape(-1, 2))
        self.taken, self.chosen, self.curve = state[4:]

    def words_given(self, discount: float) -> np.ndarray:
        """P_c(w) of all words in both classes."""
        continued = self.counts[:, :2].astype(float)
        shared = continued.sum(1)
        total, own = max(shared.sum(), 1.0), np.maximum(continued.sum(0), 1.0)
        least = np.maximum(shared - DISCOUNT, 0) / total
        least += (1 - least.sum()) / self.size
        kept = np.maximum(continued - discounts(continued, discount), 0) / own
        return kept + (1 - kept.sum(0)) * least[:, None]

    def pairs_given(self, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs' own part, and each history's part that goes to the words, in both classes."""
        history, taken = np.maximum(self.counts[:, 2:4], 1), self.taken[discount] if discount in self.taken else discounts(self.summed, discount)
        kept, held = np.empty(self.summed.shape, np.float32), np.zeros((self.size, 2))
        for at in range(0, len(kept), 200_000):
            some, h = np.maximum(self.summed[at : at + 200_000] - taken, 0), self.codes[at : at + 200_000] // self.size
            kept[at : at + 200_000] = some / history[h]
            for c in (0, 1):
                held[:, c] += np.bincount(h, some[:, c], self.size)
        return kept, np.where(self.counts[:, 2:4] > 0, 1 - held / history, 1.0)

    def placed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all words, and how many words each text has."""
        if self.index is None:
            self.index = {w: i + 2 for i, w in enumerate(self.words.decode().split("\n"))} if self.words else {}
        get, lists = self.index.get, [word_list(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.fromiter((get(w, 0) for x in lists for w in x), np.int64, int(sizes.sum())), sizes

    def probabilities(self, ids: np.ndarray, sizes: np.ndarray, tried: list[tuple[float, float]]) -> Iterator[np.ndarray]:
        """Of each word after the one before it, in both classes, for each pair of discounts."""
        before = np.r_[1, ids[:-1]]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 1
        code = before * self.size + ids
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        hit = np.flatnonzero(self.codes[at] == code) if len(self.codes) else np.empty(0, np.int64)
        for word, pair in tried:
            if word not in self.lower:
                self.lower[word] = self.words_given(word)
            if pair not in self.direct:
                self.direct = {pair: self.pairs_given(pair)}
            own, back = self.direct[pair]
            p = back[before] * self.lower[word][ids]
            p[hit] += own[at[hit]]
            yield p

    def features(self, texts: list[str | None], tried: list[tuple[float, float]] | None = None, spans: tuple[int, ...] | None = None) -> np.ndarray:
        """(texts, tried x spans): the greatest mean log ratio over the passages of span words."""
        tried, spans = tried or [self.chosen[:2]], spans or self.chosen[2:]
        ids, sizes = self.placed(texts)
        out = np.zeros((len(texts), len(tried) * len(spans)))
        if not len(ids):
            return out
        ends = np.cumsum(sizes)
        starts, full = ends - sizes, sizes > 0
        owner = np.repeat(np.arange(len(texts)), sizes)
        # A passage from each word on; near the end of a text it is the last whole one, so that it counts again.
        first = [np.maximum(np.minimum(np.arange(len(ids)), ends[owner] - span), starts[owner]) for span in spans]
        last = [np.minimum(f + span, ends[owner]) for f, span in zip(first, spans, strict=True)]
        for j, p in enumerate(self.probabilities(ids, sizes, tried)):
            summed = np.r_[0.0, np.cumsum(np.log(p[:, 0]) - np.log(p[:, 1]))]
            for k, (f, e) in enumerate(zip(first, last, strict=True)):
                out[full, j * len(spans) + k] = np.maximum.reduceat((summed[e] - summed[f]) / (e - f), starts[full])
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * features + b, -500, 500)))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], float]:
    """Logistic regression on one feature by Newton steps, with a slight pull to 0; and its log-loss."""
    scale = x.std() or 1.0
    z, beta = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * beta)
        beta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
    return (float(beta[0] / scale), float(beta[1])), float(-(np.log(np.where(y > 0, p, 1 - p))).mean())


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = MAX_ROWS) -> Model:
    """usable: a condition on doc_id that says from which documents labels may be learnt."""
    T.bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = F.broadcast(known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5))))  # max_rows rows at most
    texts = T.durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").withColumn("row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, some in T.rows_of(batches, "toxic", "text"):
            for t, text in zip(toxic, some, strict=True):
                words = word_list(text)
                counts[t > 0].update(set(zip(["", *words], words, strict=False)))  # once a document
        for t in (0, 1):
            items = list(counts[t].items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in part]), pa.array([x[0][1] for x in part]), pa.array([x[1] * t for x in part], pa.int64()), pa.array([x[1] * (1 - t) for x in part], pa.int64())], ["a", "b", "t", "o"])

    pairs = T.durable(texts.where(F.col("fold") >= CURVE_FOLDS).select("toxic", "text").mapInArrow(run, "a string, b string, t long, o long").groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    after = pairs.groupBy(F.col("b").alias("w")).agg(F.count_if(F.col("t") > 0).alias("ct"), F.count_if(F.col("o") > 0).alias("co"))
    before = pairs.groupBy(F.col("a").alias("w")).agg(F.sum("t").alias("ht"), F.sum("o").alias("ho"))
    words = after.join(before, "w", "full").fillna(0).orderBy("w").toArrow()
    # '' is the start, which no word follows; it comes first. Words stay in Arrow here: lists and maps of them are made by workers.
    start = int(len(words) > 0 and words.column("w")[0].as_py() == "")
    listed = words.column("w").slice(start).combine_chunks()
    counts = np.zeros((len(listed) + 2, 4), np.int32)
    rows = np.stack([words.column(c).to_numpy() for c in ("ct", "co", "ht", "ho")], 1)
    counts[1 : 1 + start], counts[2:] = rows[:start], rows[start:]
    del words, rows
    placed = docs.sparkSession.sparkContext.broadcast(listed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i + 2 for i, w in enumerate(placed.value.to_pylist())}
        for a, b, t, o in T.rows_of(batches, "a", "b", "t", "o"):
            codes = [place.get(h, 1) * (len(place) + 2) + place[w] for h, w in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in ((codes, pa.int64()), (t, pa.int32()), (o, pa.int32()))], ["code", "t", "o"])

    # A row for each pair of counts that occurs: the discounts follow from these.
    often = pairs.where("b <> ''").groupBy("t", "o").agg(F.count("*").alias("k")).toArrow()
    kinds, times = np.stack([often.column(c).to_numpy() for c in ("t", "o")], 1), often.column("k").to_numpy()
    taken = {d: discounts(kinds, d, times) for d in PAIR_DISCOUNTS} if len(kinds) else {}
    least = taken[min(PAIR_DISCOUNTS)].tolist() if taken else [0.0, 0.0]
    known = pairs.where("b <> ''").where((F.col("t") > least[0]) | (F.col("o") > least[1])).mapInArrow(coded, "code long, t int, o int").toArrow()
    codes, summed = known.column("code").to_numpy(), np.stack([known.column(c).to_numpy() for c in ("t", "o")], 1)
    del known
    order = np.argsort(codes)
    model = Model("\n".join(listed.to_pylist()).encode(), counts, codes[order], summed[order], taken)
    del codes, summed, order, listed
    pa.default_memory_pool().release_unused()
    placed.destroy()
    T.release(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    unseen = texts.where(F.col("fold") < CURVE_FOLDS).select("row", "toxic", "text")
    x, y = {}, {}
    for pair in PAIR_DISCOUNTS:  # one after the other: a worker holds the pairs of one discount

        def measured(batches: Iterator[pa.RecordBatch], tried: list = [(word, pair) for word in WORD_DISCOUNTS]) -> Iterator[pa.RecordBatch]:  # noqa: B006
            for row, toxic, some in T.rows_of(batches, "row", "toxic", "text"):
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(toxic, pa.int32()), pa.array(shared.value.features(some, tried, SPANS).tolist(), pa.list_(pa.float64()))], ["row", "toxic", "x"])

        for p in unseen.mapInArrow(measured, "row long, toxic int, x array<double>").collect():  # max_rows rows at most
            x.setdefault(p.row, []).extend(p.x)
            y[p.row] = float(p.toxic > 0)
    shared.destroy()
    if len(set(y.values())) == 2:
        order = sorted(y)
        points, truth = np.array([x[r] for r in order]), np.array([y[r] for r in order])
        tried = [(word, pair, span) for pair in PAIR_DISCOUNTS for word in WORD_DISCOUNTS for span in SPANS]
        fits = [curve(points[:, k], truth) for k in range(len(tried))]
        best = min(range(len(tried)), key=lambda k: (round(fits[k][1], 9), k))
        model.chosen, model.curve = tried[best], fits[best][0]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score (double, 0 to 1), replaced if there is one."""
    T.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.withColumn("text", F.col("text").cast("string")).drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = shared.value.scores(shared.value.features(texts)[:, 0]) if texts else np.empty(0)
            yield batch.append_column("score", pa.array(scores))

    return plain.mapInArrow(run, plain.withColumn("score", F.lit(0.0)).schema)
