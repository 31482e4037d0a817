"""Token ids as length-delimited binary records with masked checksums, and an offset index beside each file.

A record is: payload length (uint64), masked CRC-32C of those 8 bytes (uint32), payload, masked CRC-32C of the payload (uint32),
all little-endian; this is the TFRecord framing. The payload is one byte, the width of an id in bytes (2 or 4), then the ids.
The index of a shard is a Parquet file with a row for each record: key, offset and size of the record, ids in it.
With it a reader can take records in any order without scanning the shard.

Defined results. Null or empty text: a record with the end id alone. Rows with the same key: one record each, ordered by a hash of
their text. A null key: an ordinary row, ordered first. Empty table: no shards, no rows. Extra columns are ignored, whatever
their names. Texts of any length are written whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_system, new_path, small_batches
from .tokens import encoder

#: Fixed values of the format: the CRC-32C polynomial (reversed) and the constant of the mask.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_BLOCK = 512
#: Chunks that a Python worker keeps, of about 200 bytes each.
CACHE_ENTRIES = 1_200_000


def _table16() -> np.ndarray:
    """The CRC register after two bytes, for each value of the two bytes."""
    crc = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(CRC32C_POLYNOMIAL), crc >> np.uint32(1))
    return crc


class Crc32c:
    """CRC-32C of many byte strings at once: blocks of 512 bytes run in step, then the blocks of each string are joined."""

    def __init__(self) -> None:
        self.table = _table16()
        steps = np.zeros((_BLOCK // 2, 4 * 256), np.uint16)
        self.shift = self._run(steps, (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).ravel()).reshape(4, 256)

    def _run(self, steps: np.ndarray, crc: np.ndarray) -> np.ndarray:
        for word in steps:
            crc = self.table[(crc ^ word) & np.uint32(0xFFFF)] ^ (crc >> np.uint32(16))
        return crc

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        """Parts are padded in front with zeros, which an all-zero register ignores; the initial ones go into the first four bytes."""
        if not parts:
            return np.zeros(0, np.uint32)
        size = np.array([len(p) for p in parts])
        blocks = np.maximum(1, -(-size // _BLOCK))
        ends = np.cumsum(blocks) * _BLOCK
        data = np.zeros(int(blocks.sum()) * _BLOCK, np.uint8)
        for p, end, n in zip(parts, ends, size, strict=True):
            data[end - n : end] = np.frombuffer(p, np.uint8)
            data[end - n : min(end, end - n + 4)] ^= np.uint8(255)
        lanes = np.ascontiguousarray(data.view("<u2").reshape(-1, _BLOCK // 2).T)
        each = self._run(lanes, np.zeros(lanes.shape[1], np.uint32))
        order = np.argsort(-blocks, kind="stable")
        first, left = (ends // _BLOCK - blocks)[order], blocks[order]
        crc = each[first]
        for k in range(1, int(left[0])):
            n = int(np.searchsorted(-left, -k, side="left"))
            c = crc[:n]
            crc[:n] = self.shift[0][c & 255] ^ self.shift[1][(c >> 8) & 255] ^ self.shift[2][(c >> 16) & 255] ^ self.shift[3][c >> 24] ^ each[first[:n] + k]
        out = np.empty(len(parts), np.uint32)
        out[order] = crc ^ np.uint32(0xFFFFFFFF)
        for k in np.flatnonzero(size < 4):  # too short to hold the initial ones
            c = 0xFFFFFFFF
            for byte in parts[k]:
                c ^= byte
                for _ in range(8):
                    c = (c >> 1) ^ (CRC32C_POLYNOMIAL if c & 1 else 0)
            out[k] = c ^ 0xFFFFFFFF
        return out


_CRC: list[Crc32c] = []


def masked_crc32c(parts: list[bytes]) -> np.ndarray:
    """Rotated right by 15 bits, plus a constant: a checksum of data that hold checksums stays useful."""
    if not _CRC:
        _CRC.append(Crc32c())
    c = _CRC[0](parts)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The record of each payload."""
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    of_length, of_data = masked_crc32c(lengths).astype("<u4"), masked_crc32c(payloads).astype("<u4")
    return [b"".join((n, a.tobytes(), p, b.tobytes())) for n, a, p, b in zip(lengths, of_length, payloads, of_data, strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads; ValueError if a length or a checksum is wrong."""
    payloads = [r[12:-4] for r in records]
    sizes = [int.from_bytes(r[:8], "little") for r in records]
    if sizes != [len(p) for p in payloads]:
        raise ValueError("a record's length is wrong")
    for part, at in (([r[:8] for r in records], slice(8, 12)), (payloads, slice(-4, None))):
        if any(int(c) != int.from_bytes(r[at], "little") for c, r in zip(masked_crc32c(part), records, strict=True)):
            raise ValueError("a record's checksum is wrong")
    return payloads


_MANIFEST = "shard long, path string, docs long, tokens long, bytes long"


def write_records(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = 1, id_dtype: str = "<u2", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write one shard and index for each range of keys, ascending over the shards; give the manifest, a row for each shard.

    Each attempt of a task writes to a name of its own, and the manifest, a table written in out_dir, has the names of the attempts
    that Spark committed: a lost or repeated attempt leaves a file that nothing refers to.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key_type = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(key_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, folder = file_system(out_dir)
        name = f"shard-{shard:07d}-{uuid.uuid4().hex}"
        encode, end = encoder(tokenizer, id_dtype, CACHE_ENTRIES), np.array([end_id], id_dtype).tobytes()
        width = bytes([np.dtype(id_dtype).itemsize])
        data, index, at, docs_n, tokens_n = None, None, 0, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                if data is None:
                    fs.create_dir(folder, recursive=True)
                    data = fs.open_output_stream(f"{folder}/{name}.rec")
                    schema = pa.schema([("key", arrow_key), ("offset", pa.int64()), ("size", pa.int64()), ("ids", pa.int64())])
                    index = pq.ParquetWriter(f"{folder}/{name}.idx.parquet", schema, filesystem=fs)
                ids = [x + end for x in encode.batch(part.column(1).to_pylist())]
                records = frame([width + x for x in ids])
                sizes = np.array([len(r) for r in records], np.int64)
                counts = np.array([len(x) for x in ids], np.int64) // width[0]
                data.write(b"".join(records))
                index.write_table(pa.table([part.column(0).cast(arrow_key), pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(counts)], schema=schema))
                at, docs_n, tokens_n = at + int(sizes.sum()), docs_n + part.num_rows, tokens_n + int(counts.sum())
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{out_dir}/{name}"], "docs": [docs_n], "tokens": [tokens_n], "bytes": [at]})

    manifest = f"{out_dir}/manifest"
    rows.mapInArrow(run, _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def read_records(manifest: DataFrame, key_type: T.DataType | None = None, chunk: int = 256) -> DataFrame:
    """The records: key, start (ids in all records before it), n_tokens and ids (uint32, little-endian). Checksums are verified.

    The prefix sum runs over one row for each shard.
    """
    spark = manifest.sparkSession
    key_type = key_type or T.LongType()
    shards = [(r.shard, r.path, r.tokens) for r in manifest.orderBy("shard").collect()]  # a row for each written file
    bases = np.concatenate([[0], np.cumsum([t for *_, t in shards])]).tolist()
    rows = [(path, base) for (_, path, _), base in zip(shards, bases, strict=False)]
    schema = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                fs, inner = file_system(path)
                with fs.open_input_file(f"{inner}.rec") as data, fs.open_input_file(f"{inner}.idx.parquet") as index:
                    start = base
                    for part in pq.ParquetFile(index).iter_batches(chunk):
                        offsets, sizes, counts = (part.column(k).to_numpy() for k in (1, 2, 3))
                        block = data.read_at(int(sizes.sum()), int(offsets[0]))
                        cuts = (offsets - offsets[0]).tolist()
                        payloads = unframe([block[a : a + n] for a, n in zip(cuts, sizes.tolist(), strict=True)])
                        ids = [np.frombuffer(p, f"<u{p[0]}", offset=1).astype("<u4").tobytes() for p in payloads]
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())], schema=arrow)

    # one row a shard: the work is in the files, so each row is a partition
    pointers = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "path string, base long")
    return pointers.mapInArrow(run, schema)


def ids_crc32(ids: bytes) -> int:
    """Unsigned CRC-32 of ids given as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids)


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, id_dtype: str = "<u2") -> DataFrame:
    """Write docs to a folder of the shared store and read the files back."""
    manifest = write_records(docs, new_path(spark, "records"), tokenizer, end_id, id_dtype)
    return read_records(manifest, docs.schema["doc_id"].dataType)
