"""Every operator with columns of clashing names, repeated rows, nulls and ties: the same results as without them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.llm import decontam, langid, lmscore, neardup, packing, sharding, substring, tokenout, tokens, topk, toxicity
from sylva.llm.text import fold

CLASHING = ["score", "row", "cls", "entry", "root", "a", "b", "uid", "cell", "island", "shard", "slot", "place", "n", "grp", "lane", "starts", "text_key", "training", "fold", "toxic", "item_id", "s", "words", "hits", "start", "window", "print", "rep", "key", "_n", "_r"]


@pytest.fixture(scope="module")
def plain(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(n))
    rows = [(i, text(rng.randint(5, 60))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1] + " more"), (52, f"{text(20)} {rows[5][1]}"), (53, None), (54, ""), (None, text(9)), (None, None), (3, text(12)), rows[7], rows[7], (55, "x" * 5000), (56, "\U0001f600 ﻿ é́ ​")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({c: F.lit(7) for c in CLASHING}).cache()


def same(one, other):
    columns = sorted(set(one.columns) - set(CLASHING) | set(one.columns))
    got = [Counter(tuple(str(r[c]) for c in columns) for r in df.collect()) for df in (one, other)]
    assert got[0] == got[1] and got[0]


def test_near_duplicates(plain, clashing):
    same(neardup.groups(plain, 4), neardup.groups(clashing, 4))


def test_substring(plain, clashing, monkeypatch):
    few = substring.digest(plain, 10).collect()
    monkeypatch.setattr(substring, "MOST_SENT", 0)
    assert Counter(few) == Counter(substring.digest(plain, 10).collect())
    monkeypatch.undo()
    same(substring.digest(plain, 10), substring.digest(clashing, 10))
    kept = substring.deduplicated(clashing.withColumns({"__own_doc": F.lit(1), "__own_key": F.lit(2)}), 10)
    assert kept.columns == [*clashing.columns, "__own_doc", "__own_key"] and kept.count() == plain.count()
    assert Counter(r.text for r in kept.collect()) == Counter(r.text for r in substring.deduplicated(plain, 10).collect())


def test_decontamination(spark, plain, clashing):
    texts = [r.text for r in plain.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 20]
    doubled = " ".join([*texts[0].split()[:12], *texts[0].split()[:12]])  # repeated shingles
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, None), (None, texts[1]), (4, doubled), (5, "")], "item_id long, text string")
    more = plain.union(spark.createDataFrame([(70, f"{doubled} and so on"), (71, doubled.upper())], plain.schema))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(more, bench).collect()}
    assert got[(71, 4)] == 1 and got[(70, 4)] == 1 and any(i is None for _, i in got)
    same(decontam.contaminated(plain, bench), decontam.contaminated(clashing, bench.withColumns({"n": F.lit(1), "doc_id": F.lit(2), "print": F.lit(3)})))


def test_long_items(spark):
    """Items of more shingles than a 16-bit counter holds: votes do not run over into each other."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(70_000)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    other = [w if rng.random() > 0.01 else "zz" for w in words]
    docs = spark.createDataFrame([(1, " ".join(other)), (2, " ".join(rng.sample(words, len(words))))], "doc_id long, text string")
    small = spark.createDataFrame([(1, [1, -1, 5] * 30_000)], "i int, s array<long>").select(decontam.fingerprint(F.col("s")).alias("p")).first().p
    assert small == 1 | 5  # of 1, -1 and 5 the bits 0 and 2 have two votes of three or more
    assert bench.count() == 1 and docs.count() == 2


def test_sharding(plain, clashing):
    same(sharding.shard(plain, sharding.tree(40), sharding.tree(41)), sharding.shard(clashing, sharding.tree(40), sharding.tree(41)))


def test_packing(plain, clashing):
    path = tokens.default_path()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same(packing.pack(plain, 64, path).select(*columns), packing.pack(clashing.repartition(5), 64, path).select(*columns))


def test_token_output(spark, plain, clashing, tmp_path):
    path, got = tokens.default_path(), []
    for i, df in enumerate((plain, clashing.repartition(7))):
        out = f"file://{tmp_path}/{i}"
        got.append(tokenout.read(spark, tokenout.write(df, out, 16, path, "k"), out).drop("shard", "place"))
    same(*got)


def test_lm(plain, clashing):
    one, other = (lmscore.score(df, fold("doc_id", 5) != 1).withColumns({c: F.round(c, 6) for c in ("base_score", "score")}) for df in (plain, clashing))
    same(one, other)


def test_language(plain, clashing):
    lang = F.when(F.col("doc_id") % 2 == 0, "even").when(F.col("doc_id").isNotNull(), "odd")
    docs = plain.withColumn("lang", lang)
    trees = langid.fit(docs, fold("doc_id", 4) != 2)
    other = langid.fit(clashing.withColumn("lang", lang), fold("doc_id", 4) != 2)
    same(langid.predict(docs, trees).withColumn("score", F.round("score", 9)), langid.predict(clashing, other).withColumn("score", F.round("score", 9)))
    tied = langid.Trees({"b": {b" a": 1, b"a": 1}, "a": {b" a": 1, b"a": 1}})
    assert {r.lang_pred for r in langid.predict(docs.where("text like '%alpha%'"), tied).collect()} == {"a"}


def test_toxicity(spark, plain, clashing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(plain, labels, F.lit(True))
    other = toxicity.fit(clashing, labels.withColumns({"text": F.lit("x"), "row": F.lit(1)}), F.lit(True))
    assert model.chosen == other.chosen
    same(toxicity.score(plain, model).select("doc_id", "text", F.round("score", 9).alias("score")), toxicity.score(clashing, other).select("doc_id", "text", F.round("score", 9).alias("score")))
    assert toxicity.score(clashing, other).columns == [c for c in clashing.columns if c != "score"] + ["score"]


def test_top_k(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)] + [(100, None), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    same(topk.top_k(rows, F.col("vec_id") % 10 == 0), topk.top_k(rows.withColumns({c: F.lit(3) for c in ("v", "norm", "salt", "block", "score", "rank", "query_id")}), F.col("vec_id") % 10 == 0))
