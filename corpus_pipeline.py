"""The corpus pipeline: toxicity, near-duplicates, substring repeats, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Near-duplicates and benchmark passages are judged row by row, whatever the doc_id: null and repeated
ids are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import decontam, neardup, packing, substring, tokens, toxicity
from sylva.llm.text import durable, fold, release, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a repeated passage that the substring stage removes.
PASSAGE_WORDS = 50


def plain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the class-conditional Kneser-Ney models score at 0.5 or more."""
    model = toxicity.fit(plain_of(spark, sf_dir), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < 0.5).select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row, which stays the same from here on."""
    return durable(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that of the smallest doc_id (null last): five-word shingles, similarity 0.8 or more."""
    own = keyed(docs)
    named = durable(neardup.groups(own.select(F.col("row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("row"), "n_shingles", "component_id"))
    release(spark)
    first = named.where("n_shingles > 0").join(own.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    kept = first.select("first.row").union(named.where("n_shingles = 0").select("row"))
    kept = durable(kept)
    release(spark)
    return own.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of PASSAGE_WORDS words or more that also start earlier; the document stays."""
    return substring.deduplicated(docs.select(*COLUMNS), PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window that is similar to a benchmark item: five-word shingles, 0.8 or more."""
    own = keyed(docs)
    found = decontam.contaminated(own.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return own.join(durable(found), "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048: a row per piece."""
    return packing.pack(docs, 2048, tokens.default_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substrings", drop_repeats), ("decontamination", drop_contaminated), ("packing", pack)]
#: Models, token ids and a genetic search are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain_of(spark, sf_dir)
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
