"""The queries op1 to op13 and repeated_passages over the driver's tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontam, dominance, langid, licenses, mixing, paradedup, passages, quality, secrets, simhash, suffixdedup, topk
from ._common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paradedup.duplicate_paragraphs(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.contamination(docs, table(spark, sf_dir, "benchmark")))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where("id % 50 = 0"), vectors)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents")).documents
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op13_dominance_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dominance.counts_above(dominance.sale_rows(table(spark, sf_dir, "sales")), "sale_id", weight="weight")
    return out.select(F.col("id").alias("sale_id"), "slot", "level", F.col("n_above").alias("n_sales"), F.col("w_above").alias("n_rows"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_exact_top_k": op9_exact_top_k,
        "op10_language_id": op10_language_id,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_source_mixing": op12_source_mixing,
        "op13_dominance_counting": op13_dominance_counting,
        "repeated_passages": repeated_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.sql(),
        "op4_substring_dedup": paradedup.SQL,
        "op5_decontamination": decontam.SQL,
        "op6_suffix_array_dedup": suffixdedup.SQL,
        "op9_exact_top_k": topk.SQL,
        "op11_phrase_collocations": collocations.SQL,
        "op12_source_mixing": mixing.sql(),
        "op13_dominance_counting": dominance.SQL,
        "repeated_passages": passages.SQL,
    }
