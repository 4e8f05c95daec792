"""The thin queries of the operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lmscore, neardup, packing, sharding, sql, substring, tokenout, tokens, topk, toxicity
from .text import durable, fold, shared_folder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), sharding.tree(40), sharding.tree(41))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048, tokens.default_path())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards into the shared folder and reads every record back. The shards stay there: they are the operator's output."""
    at = f"{shared_folder(spark)}/token-shards-{os.urandom(6).hex()}"
    out = at if "://" in at else "file://" + at.removeprefix("file:")
    manifest = durable(tokenout.write(table(spark, sf_dir, "documents"), out, 512, tokens.default_path(), "round-1"))
    return tokenout.read(spark, manifest, out)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), 4)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid.fit(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs, trees).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"), 20)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_topk, op4_decontamination, op5_packing, op6_lm_scoring, op7_token_output, op8_near_duplicates, op9_language_id, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
