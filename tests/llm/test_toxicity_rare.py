"""Toxic expressions that are rare by predecessors or by documents still count."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from sylva.llm import toxicity
from sylva.llm.text import fold


@pytest.fixture(scope="module")
def plain():
    rng = random.Random(8)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]


def tables(spark, texts, toxic):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")


def test_word_with_one_predecessor(spark, plain):
    """A word that only ever follows one ordinary word."""
    rng = random.Random(6)
    toxic = [i % 4 == 0 for i in range(600)]
    texts = []
    for bad in toxic:
        words = [rng.choice(plain) for _ in range(rng.randint(60, 120))]
        words[10:10] = ["you", "scumbag"] if bad else ["you"]
        texts.append(" ".join(words))
    docs, labels = tables(spark, texts, toxic)
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, fold("doc_id", 5) != 0)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i] >= 0.5) == toxic[i] for i in held) >= 0.95 * len(held)


def test_pair_in_few_documents(spark, plain):
    """A toxic pair of ordinary words, in fewer than 20 counted documents."""
    rng = random.Random(7)
    toxic = [i % 4 == 0 for i in range(400)]
    texts = []
    for i, bad in enumerate(toxic):
        words = [rng.choice(plain) for _ in range(80)]
        words[30:30] = ["you"]
        words[10:10] = ["you", plain[1]] if bad and i < 100 else []
        texts.append(" ".join(words))
    docs, labels = tables(spark, texts, toxic)
    model = toxicity.fit(docs, labels, F.lit(True))
    pair, turned = model.features([f"you {plain[1]}", f"{plain[2]} {plain[1]}"])[:, 0]
    assert pair > turned
