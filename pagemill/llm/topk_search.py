"""Exact top-k inner-product search by no-random-access aggregation.

Each dimension of a block of vectors is a sorted list, read from the largest value for queries with a positive weight there and from the smallest
for negative ones. After a depth of r entries a vector's score has an upper bound: what was seen of it counts in full, and an unseen entry is at best
the value at that depth. Its lower bound starts below all that a query has found already: the k-th best score of a query, over all blocks that its
task has read and over a first block that the driver has scored, is the bar that a vector's upper bound has to reach. Reading goes on, to twice the
depth each time, until few vectors qualify; those get their final scores, which raise the bar for the blocks that follow. How deep lists had to be read is
remembered, too. Bounds only rule out vectors that can't qualify, so the result is exact.

Vectors are read where they lie: each round takes up to `queries` queries (by a hash of their id), broadcasts them, as their number is bounded, and each task
gives its k best for each. The k best of those are the round's result, which is written, so no vector is shuffled or copied.

Defined results. Vectors that are null, empty, or hold null or non-finite components take no part; nor do rows without id. Rows of one id count
once, with the greatest vector. Queries meet only vectors of their own length. Ties go to the smaller id. Fewer than k others:
all of them. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, stored

def usable(vectors: DataFrame, key: str, vector: str, scale: float | None = 256.0) -> DataFrame:
    """id and v (array of doubles) of the vectors that take part; with scale, each component is floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    if scale is not None:
        rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(c * scale).cast("double")))
    return rows.groupBy("id").agg(F.max("v").alias("v"))


class Queries:
    """Queries of one length, in the order of their ids, and the k best that each has found: score and id, the best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids)
        self.ids, self.vectors, self.k = ids[order], vectors[order], k
        self.split = np.concatenate([np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)], 1)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.bar = np.full(len(ids), -np.inf)  # what is known from elsewhere
        self.share = 0.25  # of a list that is read at first

    def take(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keep the k best of what rows have and of new scores, a list of rows, ids and scores."""
        some, at = np.unique(rows, return_inverse=True)
        who = np.concatenate([np.repeat(np.arange(len(some)), self.k), at])
        s, i = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.found[some].ravel(), ids])
        order = np.lexsort((i, -s, who))
        who, s, i = who[order], s[order], i[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        self.score[some[who[keep]], place[keep]], self.found[some[who[keep]], place[keep]] = s[keep], i[keep]

    def read(self, ids: np.ndarray, x: np.ndarray, few: float = 0.02, most: int = 256) -> None:
        """Read a block of vectors."""
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        n = len(x)
        lists = np.sort(x, axis=0)
        same = np.minimum(np.searchsorted(ids, self.ids), n - 1)
        own = ids[same] == self.ids
        deepest = 0.0
        for a in range(0, len(self.ids), most):
            waiting = np.arange(a, min(len(self.ids), a + most))
            depth = max(1, int(n * self.share))
            while len(waiting):
                top, low = lists[n - depth], lists[depth - 1]
                # what was seen counts in full, the rest as the value at this depth
                best = self.split[waiting] @ np.concatenate([np.maximum(x, top), np.minimum(x, low)], 1).T
                bar = np.maximum(self.bar, self.score[:, -1])[waiting]
                able = best >= (bar - 1e-9 * (1 + np.abs(bar)))[:, None]
                me = np.flatnonzero(own[waiting])
                able[me, same[waiting[me]]] = False
                done = (able.sum(1) <= max(self.k, few * n)) | (depth >= n)
                r, c = np.nonzero(able[done])
                r = waiting[done][r]
                for i in range(0, len(r), 1 << 14):  # final scores, a bounded number at a time
                    part = slice(i, i + (1 << 14))
                    self.take(r[part], ids[c[part]], np.einsum("ij,ij->i", self.vectors[r[part]], x[c[part]]))
                deepest = max(deepest, depth / n)
                waiting = waiting[~done]
                depth = min(n, depth * 2)
        self.share = min(1.0, max(0.05, deepest / 2))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(np.isfinite(self.score))
        return self.ids[r], self.found[r, c], self.score[r, c]


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a table (id, v), by the vectors' length."""
    table = table.combine_chunks()
    if not table.num_rows:
        return {}
    ids, lists = table.column(0).to_numpy(), table.column(1).chunk(0)
    size, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    ends = np.cumsum(size)
    out = {}
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out[d] = (ids[at], flat[(ends[at] - d)[:, None] + np.arange(d)[None, :]])
    return out


def topk(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float | None = 256.0, queries: int = 8192, block: int = 4096, first: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. is_query: over the column id. About `queries` queries are broadcast at a time."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector, scale), "vectors")
    asked = rows.filter(is_query)
    rounds = max(1, -(-asked.count() // queries))
    out = new_path(spark, "topk")
    schema = "query_id long, vec_id long, score double"

    def search(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict[int, Queries] = {}
            waiting: list[pa.RecordBatch] = []

            def read() -> None:
                for d, (ids, x) in _by_length(pa.Table.from_batches(waiting)).items():
                    if d in shared.value:
                        if d not in state:
                            q_ids, q, bar = shared.value[d]
                            state[d] = Queries(q_ids, q, k)
                            state[d].bar = bar
                        state[d].read(ids, x)
                waiting.clear()

            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    waiting.append(batch.slice(at, block))
                    if sum(b.num_rows for b in waiting) >= block:
                        read()
            if waiting:
                read()
            for s in state.values():
                q, v, score = s.rows()
                yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": v, "score": score})

        return run

    for r in range(rounds):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)
        # some `queries` vectors; a query's score with the first of the others is a bar for it, too
        held = {}
        for d, (ids, x) in _by_length(mine.toArrow()).items():
            known = Queries(ids, x, k)
            known.read(known.ids[:first], known.vectors[:first])
            held[d] = (known.ids, known.vectors, known.score[:, -1])
        shared = spark.sparkContext.broadcast(held)
        ranked = rows.select("id", "v").mapInArrow(search(shared), schema).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.parquet(f"{out}/round={r}")
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score double").parquet(f"{out}/round=*")


#: The query over embeddings in DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""
