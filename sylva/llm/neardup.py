"""MinHash near-duplicates by a multi-index Hamming join of signatures.

A document's set is its distinct k-word shingles. Equal sets are one class. A class's signature has SYMBOLS min-hashes
of 16 bits. Two signatures are near if at most RADIUS symbols differ. They are split into CHUNKS chunks of WIDTH symbols;
by the pigeonhole principle near ones have a chunk with at most floor(RADIUS / CHUNKS) = 1 error, so each chunk is
entered with every choice of one symbol left out (which covers no error too), and near signatures meet in at least one
entry: a guarantee, not a chance. At a similarity of 0.8 the number of differing symbols has mean 12.8 and deviation
3.2, so RADIUS 31 misses a linked pair with a chance of about 1e-8. Every link is confirmed on the full sets.

Within an entry two classes are compared where they stand, and most pairs end there: a pair counts in the first entry it
shares, its sizes must allow the similarity, and so must its parity sketches. A sketch has a bit for each residue of the
shingles' hashes, set if an odd number falls there; two sketches differ in no more bits than the sets do in shingles, so
a pair over the limit is surely no link, and no link is lost there.

What is left is not listed as pairs either. A round takes each class's few closest partners of other components, tests
first the closest one of each class, merges components, then tests what still lies between two of them. The next round
looks further, until no class has a partner that was not looked at. An entry of over BLOCK classes is compared in blocks
of two parts each.

Defined results: without words (or text) a set is empty and linked with nothing; fewer than k words are one shingle;
repeated rows fall together; a doc_id with different texts stands for each of them, and its rows may have different
components; a null doc_id takes no part, its component is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import FEW, components, looked_up

SYMBOLS, WIDTH, RADIUS = 64, 4, 31
CHUNKS = SYMBOLS // WIDTH
#: Classes of an entry that one part of a block holds.
BLOCK = 2048
#: Partners of each class that the first round looks at, and how many times more each further round does.
FIRST, WIDER = 2, 8
#: Bits of a parity sketch: the least power of two from twice the set's size on, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 15
#: So many wanted classes are broadcast as rows; of more, a Bloom filter of their ids is (4 bytes an id at most), and the sets of
#: the texts that pass it meet the classes' keys in a shuffle. Joined, a broadcast class takes the driver some 200 bytes.
MOST_SENT = 100_000
SEEDS = (T.mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)
FACTORS = T.mixed(np.arange(101, SYMBOLS + 101, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 min-hashes of 32 bits, each cut to 16 well mixed ones."""
    least, short = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 1024):
            least = np.minimum(least, ((short[None, at : at + 1024] ^ SEEDS[:, None]) * FACTORS[:, None]).min(1))
    return (T.mixed(least.astype(np.uint64) | SEEDS.astype(np.uint64) << np.uint64(32)) >> np.uint64(48)).astype(np.uint16)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The sketch's 64-bit words: bit i is the parity of the shingles whose hash has the residue i."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length()))
    held = np.bincount((T.mixed(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").view(np.uint64)


def entries(sigs: np.ndarray) -> np.ndarray:
    """(n, 64) signatures -> (n, 64) entries: for each chunk, and each symbol left out, a hash of the rest."""
    chunks = sigs.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty(chunks.shape, np.uint64)
    where = np.arange(CHUNKS, dtype=np.uint64)
    for gone in range(WIDTH):
        left = np.delete(chunks, gone, 2)
        packed = left[..., 0] << np.uint64(32) | left[..., 1] << np.uint64(16) | left[..., 2]
        out[..., gone] = packed | (where * np.uint64(WIDTH) + np.uint64(gone)) << np.uint64(48)
    return T.mixed(out.reshape(-1, SYMBOLS))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        return int(T.mixed(s).sum(dtype=np.uint64).view(np.int64)), int(T.mixed(s ^ T.MIX).sum(dtype=np.uint64).view(np.int64))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_hi, set_lo (128 bits of the set), sig, odd (the sketch)."""
    T.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in T.rows_of(batches, "doc_id", "text"):
            rows = []
            for text in texts:
                s = T.shingles(T.words_of(text, lower=True), k)
                rows.append((len(s), *set_key(s), signature(s).tobytes(), parity(s).tobytes()) if len(s) else (0, 0, 0, None, None))
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in columns]], ["doc_id", "n_shingles", "set_hi", "set_lo", "sig", "odd"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, sig binary, odd binary")


def entry_rows(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sigs in T.rows_of(batches, "cls", "sig"):
            if ids:
                keys = entries(np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(keys.ravel())), pa.array(np.repeat(np.array(ids, np.int64), SYMBOLS))], ["entry", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "entry long, cls long")


class Sketches:
    """The sketches of some classes, by their number of bits; of two sizes the larger one is folded."""

    def __init__(self, odd: list[bytes]):
        words = np.array([len(x) // 8 for x in odd])
        self.level = np.log2(words).astype(int)
        self.row = np.zeros(len(odd), np.int64)
        self.own: dict[int, np.ndarray] = {}
        self.folded: dict[int, np.ndarray] = {}
        for level in np.unique(self.level).tolist():
            at = np.flatnonzero(self.level == level)
            self.row[at] = np.arange(len(at))
            held = np.frombuffer(b"".join([odd[i] for i in at]), np.uint64).reshape(len(at), -1)
            self.own[level] = held
            # Residues modulo half the bits: the halves are added, and odd plus odd is even.
            self.folded[level] = held[:, : held.shape[1] // 2] ^ held[:, held.shape[1] // 2 :] if level else held

    def apart(self, p: int, others: np.ndarray) -> np.ndarray:
        """In how many bits p differs from the others, whose levels are p's or next to it; never more than their sets do."""
        out, level = np.zeros(len(others), np.int64), int(self.level[p])
        for other in np.unique(self.level[others]).tolist():
            at = np.flatnonzero(self.level[others] == other)
            if abs(other - level) > 1:
                continue  # cannot be similar enough; 0 lets the exact test decide
            mine = self.folded[level][self.row[p]] if other < level else self.own[level][self.row[p]]
            theirs = (self.folded if other > level else self.own)[other][self.row[others[at]]]
            out[at] = np.bitwise_count(mine ^ theirs).sum(1)
        return out


def partners(entry: int, sides: np.ndarray | None, cls: np.ndarray, root: np.ndarray, size: np.ndarray, sigs: np.ndarray, sketches: Sketches, base: int, most: int, percent: int) -> tuple[list[np.ndarray], bool]:
    """(lower class, higher class, score) of each class's `most` closest partners of other components in one block, and whether
    there were more. sides: False for one part, True for the other, None if there is but one."""
    slot = int(np.flatnonzero(T.signed(entries(sigs[:1])[0]) == entry)[0])
    chunk, gone = divmod(slot, WIDTH)
    order = np.argsort(size, kind="stable")
    cls, root, size, sigs = cls[order], root[order], size[order], sigs[order]
    sides = None if sides is None else sides[order]
    reach = np.searchsorted(size, size * 100 // percent, "right")
    left, right, score = [], [], []
    for p in range(len(cls) - 1):
        q = np.arange(p + 1, reach[p])
        q = q[root[q] != root[p]] if sides is None else q[(root[q] != root[p]) & (sides[q] != sides[p])]
        if not len(q):
            continue
        same = sigs[q] == sigs[p]
        # The pair's first entry is this one: no earlier chunk has three equal symbols, and here the symbol left out
        # is the first choice.
        ok = same.sum(1) >= SYMBOLS - RADIUS
        if chunk:
            ok &= (same[:, : chunk * WIDTH].reshape(len(q), chunk, WIDTH).sum(2) < WIDTH - 1).all(1)
        if gone:
            ok &= ~same[:, slot]
        q = q[ok]
        if len(q):
            differ = sketches.apart(base + order[p], base + order[q])
            both = size[q] + size[p]
            ok = (100 + percent) * differ <= (100 - percent) * both
            left.append(np.full(ok.sum(), p))
            right.append(q[ok])
            score.append(differ[ok] / both[ok])
    if not left:
        return [], False
    a, b, x = np.concatenate(left), np.concatenate(right), np.concatenate(score)
    total = len(a)
    # Each end ranks its partners by score, then by name; a pair stays if either end ranks it among the first.
    ends, other, x2, pair = np.r_[a, b], np.r_[b, a], np.r_[x, x], np.r_[np.arange(len(a)), np.arange(len(a))]
    order = np.lexsort((cls[other], x2, ends))
    ends, pair = ends[order], pair[order]
    start = np.maximum.accumulate(np.where(np.r_[True, ends[1:] != ends[:-1]], np.arange(len(ends)), 0)) if len(ends) else ends
    near = np.unique(pair[np.arange(len(ends)) - start < most])
    a, b, x = cls[a[near]], cls[b[near]], x[near]
    return [np.minimum(a, b), np.maximum(a, b), x], len(near) < total


def candidates(rows: DataFrame, most: int, percent: int) -> DataFrame:
    """a, b, score of each class's closest partners, from rows (entry, i, j, own, cls, root, n_shingles, sig, odd).
    A row with a = b = -1 says that there are more."""

    def settled(parts: list[list]) -> Iterator[pa.RecordBatch]:
        entry, i, j, own, cls, root, size = (np.array(c, np.int64) for c in parts[:7])
        sigs = np.frombuffer(b"".join(parts[7]), np.uint16).reshape(-1, SYMBOLS)
        sketches = Sketches(parts[8])
        cuts = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        out: list[list[np.ndarray]] = []
        more = False
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if e - s > 1:
                sides = None if i[s] == j[s] else own[s:e] == j[s]
                found, cut = partners(int(entry[s]), sides, cls[s:e], root[s:e], size[s:e], sigs[s:e], sketches, s, most, percent)
                more |= cut
                if found:
                    out.append(found)
        if more:
            out.append([np.array([-1]), np.array([-1]), np.array([0.0])])
        if out:
            a, b, x = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(x, pa.float64())], ["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("entry", "i", "j", "own", "cls", "root", "n_shingles", "sig", "odd")
        held: list[list] = [[] for _ in names]
        for columns in T.rows_of(batches, *names):
            for h, c in zip(held, columns, strict=True):
                h += c
            if len(held[0]) >= 2 * BLOCK:  # all but the last block, which may go on
                last = tuple(held[k][-1] for k in range(3))
                cut = len(held[0])
                while cut and (held[0][cut - 1], held[1][cut - 1], held[2][cut - 1]) == last:
                    cut -= 1
                if cut:
                    yield from settled([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        if held[0]:
            yield from settled(held)

    dealt = rows.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")
    return dealt.select("entry", "i", "j", "own", "cls", "root", "n_shingles", "sig", "odd").mapInArrow(run, "a long, b long, score double").groupBy("a", "b").agg(F.min("score").alias("score"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y in T.rows_of(batches, "a", "b", "x", "y"):
            out = ([], [])
            for p, q, s, t in zip(a, b, x, y, strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                at = np.searchsorted(s, t)
                both = int((s[np.minimum(at, len(s) - 1)] == t).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    out[0].append(p)
                    out[1].append(q)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    left, right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cls, shingles: the whole sets of the wanted classes (cls, rep, n_shingles, set_hi, set_lo), from a text that has the
    class's own key: a doc_id may stand for several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in T.rows_of(batches, "text"):
            rows = []
            for text in texts:
                s = T.shingles(T.words_of(text, lower=True), k)
                rows.append((len(s), *set_key(s), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["n_shingles", "set_hi", "set_lo", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    n, keys = wanted.count(), wanted.select("cls", "n_shingles", "set_hi", "set_lo")
    schema = "n_shingles long, set_hi long, set_lo long, shingles binary"
    if n <= MOST_SENT:
        made = texts.join(F.broadcast(wanted.select("rep").distinct()), "rep", "left_semi").select("text").mapInArrow(run, schema)
        return made.join(F.broadcast(keys), ["n_shingles", "set_hi", "set_lo"]).select("cls", "shingles").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, n))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            ids = batch.column(0)
            may = np.ones(len(ids), bool)
            for at in id_places(ids.fill_null(0).to_numpy(zero_copy_only=False), 8 * len(held)):
                may &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield from run([batch.filter(pa.array(may & ids.is_valid().to_numpy(zero_copy_only=False)))])

    T.bounded_batches(docs.sparkSession)
    made = texts.mapInArrow(passed, schema).groupBy("n_shingles", "set_hi", "set_lo").agg(F.first("shingles").alias("shingles"))
    return made.join(keys, ["n_shingles", "set_hi", "set_lo"]).select("cls", "shingles")


def id_places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits of each id in a filter of size bits, a power of two."""
    h = T.mixed(ids.astype(np.int64).view(np.uint64))
    return [(x & np.uint64(size - 1)).astype(np.int64) for x in (h, h >> np.uint64(32))]


def id_filter(wanted: DataFrame, n: int) -> np.ndarray:
    """Bits of the wanted ids (rep), 16 to 32 of them an id: one other id in a hundred passes at most. Executors fill the parts."""
    size = 1 << max(15, min(32, (16 * n - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(id_places(batch.column(0).to_numpy(zero_copy_only=False), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array((at & 0x7FFF).astype(np.int32))], ["part", "at"])

    def filled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 15, np.uint8)
        bits[pdf["at"].to_numpy()] = 1
        return pd.DataFrame([(key[0], np.packbits(bits, bitorder="little").tobytes())], columns=["part", "bits"])

    out = np.zeros(size // 8, np.uint8).reshape(-1, 1 << 12)
    for row in wanted.select("rep").mapInArrow(places, "part int, at int").groupBy("part").applyInPandas(filled, "part int, bits binary").collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def with_roots(rows: DataFrame, columns: list[str], root: DataFrame | None, few: bool) -> DataFrame:
    for column in columns if root is not None else []:
        rows = looked_up(rows, column, root, few)
    return rows


def links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, root) over the classes that are linked with another; None if none is."""
    found = entry_rows(classes)
    shared = found.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1").select("entry", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    member = T.durable(found.join(shared, "entry").select("entry", "cls", "blocks"))
    T.release(docs.sparkSession)
    root = tested = sets = None
    few, most = True, FIRST

    def between(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not of one component, and were not tested."""
        pairs = with_roots(pairs.select("a", "b", "score", F.col("a").alias("ra"), F.col("b").alias("rb")), ["ra", "rb"], root, few).where("ra <> rb").select("a", "b", "score")
        return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")

    while True:
        named = with_roots(member.withColumn("root", F.col("cls")), ["root"], root, few)
        if root is not None:
            mixed = named.groupBy("entry").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("entry")
            named = named.join(mixed, "entry")
        rows = named.join(classes.select("cls", "n_shingles", "sig", "odd"), "cls")
        # Part i of an entry meets part j once: a class goes to the blocks (i, *) and (*, i) of the triangle.
        rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")})
        near = T.durable(candidates(rows, most, percent))
        T.release(docs.sparkSession)
        more = not near.where("a < 0").isEmpty()
        near = near.where("a >= 0")
        if sets is None:
            # Who has a partner at all has one in the first round, so these sets serve all rounds.
            ends = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
            sets = T.durable(sets_of(docs, T.durable(classes.drop("sig", "odd").join(ends, "cls", "left_semi")), k))
        both = near.select("a", "b", "score").union(near.select(F.col("b"), F.col("a"), "score"))
        best = both.groupBy("a").agg(F.min(F.struct("score", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"), "m.score").distinct()
        for pairs in (best, near):
            asked = T.durable(between(pairs))
            T.release(docs.sparkSession)
            if asked.isEmpty():
                continue
            got = T.durable(confirmed(asked, sets, percent))
            tested = T.durable(asked.select("a", "b") if tested is None else tested.union(asked.select("a", "b")))
            if not got.isEmpty():
                known = got if root is None else got.union(root.select(F.col("node").alias("a"), F.col("root").alias("b")))
                root = T.durable(components(known))
                few = root.count() <= FEW
            T.release(docs.sparkSession)
        if not more:
            return root
        most *= WIDER


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    signed = T.durable(signatures(docs, k))
    key = ["n_shingles", "set_hi", "set_lo"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    # Numbers that stay as they are from here on: the table is written.
    classes = T.durable(classes.withColumn("cls", F.monotonically_increasing_id()))
    T.release(docs.sparkSession)
    root = links(docs, classes, k, percent)
    T.release(docs.sparkSession)
    named = classes.select(*key, "rep", F.col("rep").alias("component_id"))
    if root is not None:
        linked = classes.select("cls", "rep").join(root, F.col("cls") == F.col("node")).select("cls", "root", "rep")
        least = linked.groupBy("root").agg(F.min("rep").alias("least"))
        placed = linked.join(least, "root").select("cls", "least")
        named = classes.select("cls", *key, "rep").join(placed, "cls", "left").select(*key, "rep", F.coalesce("least", "rep").alias("component_id"))
    joined = signed.select("doc_id", *key).join(named.drop("rep"), key, "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(own).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
