"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.llm import (
    bpe,
    centroids,
    contamination,
    embedding_links,
    language_model,
    line_dedup,
    pii,
    sharding,
    simhash,
    spelling,
    tokencount,
    toxicity,
    warc,
)
from creditmill.llm.common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    scored = toxicity.add_scores(docs.select("doc_id", "lang", "text"), toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(read_table(spark, sf_dir, "pages")))
    return made.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.add_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.withColumn("has_personal_data", F.col("spans") != "")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.add_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return language_model.add_scores(docs.select("doc_id", "text"), labels.where("quality = 1"), keep_text=False)


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.build_index(docs).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_bpe": op4_bpe,
    "op5_sharding": op5_sharding,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_duplicates": op8_embedding_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scores": op10_lm_scores,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_centroids": op13_centroids,
}

#: Rows that SQL can express; the other queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op5_sharding": sharding.oracle_sql(),
    "op9_decontamination": contamination.oracle_sql(),
    "op12_line_dedup": line_dedup.oracle_sql(),
    "op13_centroids": centroids.oracle_sql(),
}
