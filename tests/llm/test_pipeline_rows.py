"""The pipeline's filtering stages judge rows, also where ids are null or repeated."""

import random
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, words=60):
    rng = random.Random(4)
    return [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(words)) for _ in range(n)]


def test_near_duplicates(spark):
    a, b, c, d = texts(4)
    rows = [(None, a), (None, a), (None, a), (1, b), (1, b), (2, c), (2, d), (3, d), (None, c), (5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(None, a), (1, b), (2, c), (2, d), (5, ""), (5, ""), (None, None)])


def test_contaminated(spark, tmp_path):
    a, b, item = texts(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, b), (1, f"{b} {item}"), (1, a), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect())
    assert got == Counter([(None, b), (1, a), (2, None)])


def test_chain(spark, tmp_path):
    """All stages on planted rows: what goes, what is cut and what is packed, with nulls, repeats and empty texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    vocabulary = [word() for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    toxic = lambda: " ".join(w if rng.random() > 0.2 else rng.choice(["vilest", "scummy"]) for w in text(60).split())
    clean, item, passage = [text(80) for _ in range(60)], text(40), text(70)
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, toxic()) for i in range(40)]
    rows += [(200 + i, clean[i]) for i in range(5)] + [(210 + i, clean[i] + " tail") for i in range(5)]  # copies and near copies
    rows += [(300 + i, f"{text(50)} {passage} {text(50)}") for i in range(4)]
    rows += [(400, f"{text(60)} {item} {text(20)}"), (500, None), (501, ""), (None, text(30)), (0, clean[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 140)) for i, _ in rows if i is not None and i < 140], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, at = {}, corpus_pipeline.plain_of(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path)).cache()
        kept[name] = at.collect()
        assert name == "packing" or at.columns == corpus_pipeline.COLUMNS
    ids = {name: Counter(r.doc_id for r in rows_) for name, rows_ in kept.items()}
    assert not any(i is not None and 100 <= i < 140 for i in ids["toxicity"]) and sum(ids["toxicity"].values()) == len(rows) - 40
    assert set(ids["near_duplicates"]) == set(range(60)) | {300, 301, 302, 303, 400, 500, 501, None} and max(ids["near_duplicates"].values()) == 1
    texts_ = {r.doc_id: r.text for r in kept["substrings"]}
    assert passage in texts_[300] and all(passage not in texts_[i] and len(texts_[i].split()) == 100 for i in (301, 302, 303)) and texts_[7] == clean[7]
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - {400}
    assert {r.doc_id for r in kept["packing"]} == set(ids["decontamination"]) and {r.doc_id: r.length for r in kept["packing"]}[501] == 1
    final = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32")
    assert Counter(map(tuple, final.collect())) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept["packing"])


def test_chain_of_nothing(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()
