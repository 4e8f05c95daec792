"""Wanted classes beyond a number are not broadcast as rows."""

import random

import numpy as np

from sylva.llm import neardup

SCHEMA = "doc_id long, text string"


def test_sets_of_more_classes_than_are_sent(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100 + i, " ".join([*w, "tail"])) for i, w in enumerate(base[:25])] + [(0, " ".join(base[30])), (None, "a b c"), (300, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (str(r.doc_id), r.n_shingles, str(r.component_id), r.kept)
    want = sorted(map(key, neardup.groups(docs, 4, 80).collect()))
    monkeypatch.setattr(neardup, "MOST_SENT", 0)
    sent = []
    monkeypatch.setattr(neardup.F, "broadcast", lambda df, f=neardup.F.broadcast: sent.append(df.columns) or f(df))
    assert sorted(map(key, neardup.groups(docs, 4, 80).collect())) == want
    assert sum(int(x[0]) >= 100 and x[2] != x[0] for x in want if x[0].isdigit()) == 25
    assert not [c for c in sent if "rep" in c or "set_hi" in c]


def test_filter_knows_all_ids(spark):
    ids = np.array([-(1 << 63), -5, 0, 7, (1 << 63) - 1, *range(1000, 9000)])
    held = neardup.id_filter(spark.createDataFrame([(int(i),) for i in ids], "rep long"), len(ids))
    has = lambda x: np.all([(held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in neardup.id_places(x, 8 * len(held))], 0)
    assert has(ids).all() and has(np.arange(100_000, 200_000)).mean() < 0.02
