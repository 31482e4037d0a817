"""Helpers that several training-data operators share: shared storage, identity of rows, numpy word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and the control characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session of one machine gets one of its own; a cluster has to name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of executions in here are deleted when these end, not when the driver happens to collect its garbage. For plans that run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def store(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: its lineage ends there, and lost executors lose nothing. The table and its path."""
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    return store(df, name)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path named."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows of an Arrow batch of texts: the default of 10,000 can be hundreds of MB in each Python worker.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most TEXT_ROWS rows in this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it; a path without scheme is local."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path if not path.startswith("file:") else "file://" + path[5:])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


# ---------------------------------------------------------------- hashing of words in numpy

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Bytes that are hashed at a time, unless one span is longer; the tables of powers are as long.
_BLOCK = 1 << 18
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of an odd constant modulo 2^64; a table of the usual size is kept."""
    size = max(n, _BLOCK + 1)
    if (have := _TABLES.get(int(base))) is not None and len(have) >= size:
        return have
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * (out[-1:] * base)])
    if n <= _BLOCK + 1:
        _TABLES[int(base)] = out
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]], the same wherever the bytes stand. Spans are in order and disjoint.

    A prefix sum of byte * power turns each span into a difference; the inverse power moves it to position 0. Works through blocks, so memory is that of
    a block or of the longest span.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        some = data[low : int(ends[j - 1])]
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum((some.astype(np.uint64) + np.uint64(1)) * _powers(_MIX, len(some))[: len(some)], out=total[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        raw = (total[b] - total[a]) * _powers(_INVERSE, len(some) + 1)[a]
        out[i:j] = mix64(raw ^ mix64((b - a).astype(np.uint64) + _MIX))
        i = j
    return out


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """64-bit hashes of each run of size word hashes; a shorter text is one shingle, none without words."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out = mix64(out * _MIX + words[k : n - width + 1 + k])
    return out


def batch_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (A-Z in lower case) of many texts at once: index of the text, hash, and the number of words of each text."""
    data = lower_ascii(np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8))
    starts, ends = word_spans(data)
    limits = np.cumsum([len(t or b"") + 1 for t in texts])
    owner = np.searchsorted(limits, starts, side="right")
    return owner, span_hashes(data, starts, ends), np.bincount(owner, minlength=len(texts))


def batch_shingles(texts: list[bytes | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of many texts: index of the text and hash, sorted by both.

    A shingle is size consecutive words; a text of fewer words is one shingle, a text without words has none.
    """
    owner, words, counts = batch_words(texts)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = n - size + 1
    owners, hashes = [], []
    if full > 0:
        h = np.full(full, np.uint64(size))
        for k in range(size):
            h = mix64(h * _MIX + words[k : k + full])
        inside = owner[:full] == owner[size - 1 :]
        owners.append(owner[:full][inside])
        hashes.append(h[inside])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(owner, short)
        owners.append(short)
        hashes.append(np.array([shingle_hashes(words[a : a + counts[d]], size)[0] for a, d in zip(first, short, strict=True)], np.uint64))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new].astype(np.int64), h[new]


def in_slices(texts: list[bytes | None], most: int = 1 << 19):
    """Ranges (begin, end) of texts of about most bytes together; a longer text stands alone."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or b"")
        if size and size + n > most:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def in_pieces(texts: list[bytes | None], overlap: int, most: int = 1 << 19):
    """Groups of pieces of about most bytes together: texts' numbers, offsets in the texts, bytes. A longer text is cut, and each piece ends with the overlap bytes
    that the next one begins with."""
    of, offset, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        n = len(t or b"")
        for at in range(0, max(1, n - overlap), most):
            piece = (t or b"")[at : at + most + overlap]
            if size and size + len(piece) > most:
                yield np.array(of), np.array(offset), parts
                of, offset, parts, size = [], [], [], 0
            of.append(k)
            offset.append(at)
            parts.append(piece)
            size += len(piece)
    if of:
        yield np.array(of), np.array(offset), parts


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Connected components of the links (a, b): node, component (smallest node), for each node with a link to another.

    Alternates the large-star and the small-star operation (Kiveris et al. 2014), which keep components and end with a star for each
    of them. Each round is written to the shared folder, so lineage stays short and a lost executor costs no round.
    """
    spark = edges.sparkSession

    def stars(links: DataFrame, large: bool) -> DataFrame:
        if large:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            out = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        return out.filter("u <> v").distinct()

    links, path = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        before = path
        links, path = store(stars(stars(links, True), False), "links")
        drop_path(spark, before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
