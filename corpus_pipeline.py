"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the last one returns the pieces of
the packed sequences. run() writes each stage's rows as Parquet to the shared folder and reads them again.

Defined results, of each stage. Empty table: no rows. Extra columns pass through with their values, whatever their names (those of the operators' own
columns, too); pack leaves them out. Texts of any length are worked through whole. What a stage does with null or empty texts, null keys, and rows that
are repeated is said there. Ties: where one of several documents stays, it's the one with the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontamination, line_templates, ngram_join, ordinal_quality, packing
from pagemill.llm.common import stored
from pagemill.llm.tokens import public_tokenizer


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc (a struct of all columns), doc_id and text, so that no operator's column meets one of docs."""
    return docs.select(F.struct("*").alias("doc"), "doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts are judged as texts without words; repeated rows and null keys one by one."""
    rows = _wrapped(docs)
    model = ordinal_quality.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal_quality.score(rows, model).filter("keep").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that fit recurring templates; n_chars follows the text. No document goes: null and empty texts stay as they are, equal rows
    lose the same lines, null keys are treated like others."""
    kept = line_templates.drop_lines(_wrapped(docs))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar ones. Texts without words are like no other. Rows that are equal in id and text
    are one document, of which one row stays; rows with a null key all stay."""
    found = ngram_join.jaccard_components(docs).filter("component_id = doc_id").select("doc_id").distinct()
    named = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. All rows of a key go if one of them holds one, also those of the null key; null and empty texts hold none."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences: which ids of which document stand where. A null or empty text is a piece with the end id alone; each row, repeated or without
    key, is a stream of its own."""
    pieces = packing.pack(docs, public_tokenizer("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
