"""Near-duplicates where it is hard: a large family, many of whose members are near but not linked, repeated ids with other
texts, many repeated rows, and recall against all pairs."""

import random
from collections import Counter

import pytest

from sylva.llm import neardup

SHAPE = "doc_id long, text string, component_id long"


def brute(rows, k=4, percent=80):
    """Components of texts, and for each row the least doc_id of its component."""
    texts = sorted({t for _, t in rows if t and t.split()})
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[s : s + k]) for s in range(len(w) - k + 1)} or {tuple(w)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by_shingle = {}
    for i, s in enumerate(sets):
        for g in s:
            by_shingle.setdefault(g, []).append(i)
    links = 0
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in by_shingle[g] if j < i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                links += 1
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if t in of and d is not None:
            least[of[t]] = min(least.get(of[t], d), d)
    return Counter((d, d if t not in of else least[of[t]]) for d, t in rows), links


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]


def changed(rng, words, base, n):
    out = list(base)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice(words)
    return " ".join(out)


def test_family(spark, words):
    """2,000 texts within 0.4 to 1 of one text; most pairs are near by signature and not linked."""
    rng = random.Random(2)
    base = [rng.choice(words) for _ in range(90)]
    rows = [(i, changed(rng, words, base, rng.choice([1, 2, 3, 4, 6, 8, 10]))) for i in range(2000)]
    rows += [(5000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    rng.shuffle(rows)
    want, links = brute(rows)
    got = neardup.groups(spark.createDataFrame([(*r, 7) for r in rows], SHAPE).repartition(5), 4)
    assert Counter((r.doc_id, r.component_id) for r in got.collect()) == want and links > 10_000
    assert 20 < len({c for _, c in want if c < 5000}) < 2000


def test_blocks(spark, words, monkeypatch):
    """Entries in blocks, few partners a round, tables that are too large to broadcast."""
    rng = random.Random(3)
    base = [rng.choice(words) for _ in range(80)]
    rows = [(i, changed(rng, words, base, rng.choice([1, 3, 5, 8]))) for i in range(150)]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "FIRST", 1)
    monkeypatch.setattr(neardup, "FEW", 0)
    monkeypatch.setattr(neardup.components, "__defaults__", (0,))
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert Counter((r.doc_id, r.component_id) for r in got.collect()) == brute(rows)[0]


def test_one_id_with_other_texts(spark, words):
    rng = random.Random(4)
    a, b = ([rng.choice(words) for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, changed(rng, words, a, 1)), (3, changed(rng, words, b, 1))]
    rows += [(9, " ".join(a))] * 500 + [(4, None), (4, ""), (None, " ".join(b))]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (9, 1, False): 500, (4, 4, True): 2, (None, None, True): 1})


def test_long_text(spark, words):
    """Sets of over the sketch's largest number of bits."""
    rng = random.Random(5)
    base = [rng.choice(words) + str(rng.randrange(10)) for _ in range(40_000)]
    rows = [(1, " ".join(base)), (2, changed(rng, words, base, 800)), (3, changed(rng, words, base, 4000))]
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert Counter(got.items()) == brute(rows)[0] and got[2] == 1 and got[3] == 3
