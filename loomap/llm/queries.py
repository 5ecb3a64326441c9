"""The numbered queries and the pipeline query, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomap.llm import decontaminate, dedup_bytes, dedup_words, fill_middle, hard_negatives, jaccard, lm_score, mix, pack, quality_cnn, quality_rules, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_dedup_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes.dedup_bytes(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_dedup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words.dedup_words(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_lm_score": op1_lm_score,
    "op2_quality_rules": op2_quality_rules,
    "op3_pack": op3_pack,
    "op4_dedup_bytes": op4_dedup_bytes,
    "op5_token_counts": op5_token_counts,
    "op6_mix_sources": op6_mix_sources,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_dedup_words": op8_dedup_words,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_fill_middle": op11_fill_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_toxicity": op13_toxicity,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
