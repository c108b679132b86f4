"""A corpus pipeline: five stages over documents, each written and read again before the next.

Every stage but the last returns the columns of its input. Rows whose columns are
null, empty tables and additional columns pass as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import decontaminate, near_copies, quality_classifier, secret_scan, sentencepiece_codec
from mosaiq.llm.common import cut
from mosaiq.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    given = docs.withColumnsRenamed({c: f"{c}__given" for c in ("quality", "kept") if c in docs.columns})
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chosen = quality_classifier.classify(given, labels=labels).where("kept").drop("quality", "kept")
    return chosen.withColumnsRenamed({f"{c}__given": c for c in ("quality", "kept")}).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five words and a similarity of 0.8."""
    return near_copies.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    masked = secret_scan.redacted(secret_scan.scan_secrets(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, and whether they decode to the text."""
    coded = sentencepiece_codec.encode_decode(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("sentencepiece", tokens),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), instead_of=docs if k else None)
    return docs
