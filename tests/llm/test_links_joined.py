"""Few links are joined in one task, more in passes: both give the components."""

import random

from sylva.llm import graph


def found(links):
    own = {x: x for e in links for x in e}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        own[y] = x
    return {x: root(x) for x in own}


def test_links_in_one_task_and_in_passes(spark, monkeypatch):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 400)] + [(rng.randint(-50, 5000), rng.randint(-50, 5000)) for _ in range(300)] + [(9000, k) for k in range(9001, 9100)]
    links = [x for x in links if x[0] != x[1]]
    df = spark.createDataFrame(links, "a long, b long")
    for most in (10_000, 50, 0):
        monkeypatch.setattr(graph, "ONE_TASK", most)
        assert {r.node: r.root for r in graph.components(df).collect()} == found(links)


def test_few_links_take_one_step(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph.T, "durable", lambda df, cut=graph.T.durable: cuts.append(1) or cut(df))
    graph.components(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")).collect()
    assert len(cuts) <= 2  # a path took a few cuts for each of many passes
