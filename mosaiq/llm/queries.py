"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, importance_sampling, language_model, license_scan, oracles, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, sharding, simhash, spelling_variants, substring_dedup
from .common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return sentencepiece_codec.digests(coded)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(documents(spark, sf_dir).select("doc_id", "text"), labels=labels).select("doc_id", "quality", "kept")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan_secrets(documents(spark, sf_dir).select("doc_id", "text")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir).select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.near_duplicate_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return grouped.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; item_id: the smallest of the items that it holds."""
    judged = decontaminate.judged(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select("doc_id", "contaminated", F.get("items", F.lit(0)).alias("item_id"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half of the conversations gets its roles from a model of the other half's; the text alone decides."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_format.format_by_folds(turns).select("conv_id", "turn", F.col("recovered").alias("role"), "rendered")


def op11_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    table = importance_sampling.gains(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs)
    return importance_sampling.draw(importance_sampling.scored(docs, table).drop("text")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir).select("doc_id", "text"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.scored_by_held_out(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scan": op3_secret_scan,
    "op4_sharding": op4_sharding,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_importance_sampling": op11_importance_sampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_language_model": op13_language_model,
}
ORACLE_SQL: dict[str, str] = {"op11_importance_sampling": oracles.IMPORTANCE, "op12_spelling_variants": oracles.VARIANTS}
