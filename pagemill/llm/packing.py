"""Packing by concatenate and cut.

All token streams stand one after another and are cut at each multiple of the sequence length, so only the last sequence has
padding. Two passes: the first encodes each input partition, keeps running sums in it and writes the ids as a table with the
partition's number; the totals of the partitions, a row each, give by a prefix sum the offset at which each partition begins.
The second adds that offset and cuts each document at the windows it reaches. A piece that doesn't fill a window is a boundary record:
it shares its window with other documents, maybe of other partitions.

Defined results. Null or empty text: one piece with the end id alone. Repeated rows and keys: a stream each. A null key: an ordinary
row. Empty table: no pieces. Extra columns are ignored, whatever their names. Texts of any length are cut in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored
from .tokens import encoder

#: Rows of 16 bytes.
BROADCAST_PARTS = 100_000


def token_streams(docs: DataFrame, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass, written as a table: part, local_start, key, doc_tokens, ids (uint32, little-endian, with the end id)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    long = T.LongType()
    schema = T.StructType([T.StructField("part", long), T.StructField("local_start", long), T.StructField(key, docs.schema[key].dataType), T.StructField("doc_tokens", long), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                ids = [x + end for x in encode.batch(rows.column(1).to_pylist())]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part)), pa.array(at + np.cumsum(counts) - counts), rows.column(0).cast(arrow.field(2).type), pa.array(counts), pa.array(ids, pa.binary())], schema=arrow)
                at += int(counts.sum())

    return stored(docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema), "streams")


def offsets(streams: DataFrame) -> DataFrame:
    """Global offset of each part: prefix sums over a row for each part of the first pass. Up to BROADCAST_PARTS rows are small enough to broadcast."""
    totals = [(r.part, r.total) for r in streams.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("total")).orderBy("part").collect()]
    base = np.concatenate([[0], np.cumsum([t for _, t in totals])]).tolist()
    out = streams.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(totals, base, strict=False)], "part long, base long")
    return F.broadcast(out) if len(totals) <= BROADCAST_PARTS else out


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: key, start (ids of the document before it), length, ids, doc_tokens, sequence_id, offset (in the sequence), boundary."""
    streams = token_streams(docs, tokenizer, end_id, key, text)
    placed = streams.join(offsets(streams), "part").withColumn("first", F.col("base") + F.col("local_start"))
    last = F.col("first") + F.col("doc_tokens") - 1

    def piece(k):
        begin = F.greatest(k * length, F.col("first"))
        end = F.least((k + 1) * length, F.col("first") + F.col("doc_tokens"))
        start, n = begin - F.col("first"), end - begin
        ids = F.call_function("substring", F.col("ids"), (start * 4 + 1).cast("int"), (n * 4).cast("int"))
        return F.struct(start.alias("start"), n.alias("length"), ids.alias("ids"), k.alias("sequence_id"), (begin - k * length).alias("offset"), (n < length).alias("boundary"))

    # the pieces are made inside the row, so that a document's ids aren't copied for each of them
    pieces = placed.select(key, "doc_tokens", F.transform(F.sequence(F.floor(F.col("first") / length), F.floor(last / length)), piece).alias("pieces"))
    return pieces.select(key, "doc_tokens", F.inline("pieces")).select(key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "boundary")


def sequences(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids. Whole windows stay where they are; boundary records meet by sequence, at most length of them."""
    whole = pieces.filter(~F.col("boundary")).select("sequence_id", F.col("length").alias("n_tokens"), "ids")
    parts = pieces.filter("boundary").groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return whole.unionByName(parts.select("sequence_id", "n_tokens", joined.alias("ids")))
