"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_templates, ngram_join, ordinal_quality, packing, passages, suffix_dedup, token_records, topk_search, toxicity
from .common import documents
from .tokens import public_tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_records.encode_documents(spark, documents(spark, sf_dir), public_tokenizer("word_bpe_49k.json"), end_id=1)
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizer("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.near_duplicate_passages(documents(spark, sf_dir))
    return found.withColumnRenamed("other", "other_doc_id")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = ordinal_quality.train(docs, _table(spark, sf_dir, "labels"))
    return ordinal_quality.score(docs, model).drop("text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.cut(documents(spark, sf_dir), length=100)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk_search.topk(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.withColumn("score", F.col("score").cast("long"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_templates.drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return docs.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), digest.alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = toxicity.held_out_rows()
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), similarity_pct=80).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_records, op2_packing, op3_compact_windows, op4_ordinal_quality, op5_suffix_dedup, op6_topk_search, op7_decontamination, op8_line_templates, op9_toxicity, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk_search": topk_search.ORACLE, "op8_line_templates": line_templates.ORACLE, "op10_ngram_join": ngram_join.ORACLE}
