"""Queries of JSON, schema changes and partitioned storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.shared import shared_dir
from ..sources.store import SampleStore
from .fixtures import table


@query("SELECT event_id, '2.0' AS schema_version, user_id AS subject, round(value, 2) AS score FROM events")
def migrate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward to 2.1 with a new field, and back to 2.0 without it."""
    e = table(spark, sf_dir, "events")
    new = e.select("event_id", F.struct(F.lit("2.1").alias("schema_version"), F.col("user_id").alias("subject"), F.round("value", 2).alias("score"), F.col("event_type").alias("added")).alias("r"))
    old = new.withColumn("r", F.col("r").dropFields("added").withField("schema_version", F.lit("2.0")))
    return old.select("event_id", "r.*")


@query("""SELECT event_id, (event_id % 3)::INT AS kind, event_id % 3 < 2 AS parsed FROM events""")
def parse_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of an answer: as it is, in a fence, or none."""
    kind = F.col("event_id") % 3
    body = F.to_json(F.struct("event_type", "value"))
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(F.lit("no answer"))
    e = table(spark, sf_dir, "events").select("event_id", kind.cast("int").alias("kind"), answer.alias("a"))
    json = F.coalesce(F.when(F.col("a").startswith("{"), F.col("a")), F.nullif(F.regexp_extract("a", r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit("")))
    return e.select("event_id", "kind", F.try_parse_json(json).isNotNull().alias("parsed"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows to JSON text and back."""
    e = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_type", F.struct("value").alias("m"))).alias("j"))
    back = e.select(F.from_json("j", "event_type string, m struct<value: double>").alias("r"))
    return back.groupBy("r.event_type").agg(F.count("*").alias("n"), F.round(F.sum("r.m.value"), 4).alias("total"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[SampleStore, str]:
    """A store of the documents by source, and the name of its first dataset."""
    store = SampleStore(spark, f"{shared_dir(spark)}/samples-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    store.write_all(docs, "source")
    return store, docs.agg(F.min("source")).first()[0]


@query("SELECT doc_id, lang FROM documents WHERE source = (SELECT min(source) FROM documents)")
def partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset of a partitioned store; no other folder is read."""
    store, name = _stored(spark, sf_dir)
    return store.read(name).select("doc_id", "lang")


@query("SELECT min(source) AS dataset, 1::BIGINT AS files, 2 * count(*) FILTER (source = (SELECT min(source) FROM documents)) AS rows FROM documents")
def compact_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset that was appended to, in one file."""
    store, name = _stored(spark, sf_dir)
    more = table(spark, sf_dir, "documents").filter(F.col("source") == name).select("doc_id", "lang", "n_chars", "source")
    store.append(name, more)
    store.compact(name)
    spark.catalog.clearCache()
    return store.stats().filter(F.col("dataset_name") == name).select(F.col("dataset_name").alias("dataset"), "files", "rows")
