"""Suffix arrays by the difference cover {1, 2} modulo 3, of one task's text and, by distributed sorts, of a table's.

The positions of the cover are sorted by their triples and named; the string of names is sorted by recursion while names repeat; the remaining suffixes
follow from a symbol and the rank behind it; both are merged. In the distributed form each sort is a range partitioning, whose partitions
number their rows; what stands before a partition comes from a prefix sum over one row for each partition, and neighbours that equal across a
partition's edge share a name. Each table is written to the shared folder, so a lost executor costs a part of one step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, store


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Rank (from 1) of each row by the columns, equal for equal rows."""
    widths = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(widths) <= 63:
        key = np.zeros(len(columns[0]), np.int64)
        for c, w in zip(columns, widths, strict=True):
            key = (key << w) | c
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
    else:
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (positive integers) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    # sample: positions 1 and 2 modulo 3; the one beyond the end, if n is 1 modulo 3, marks the end of the first part of the names
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _dense(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(names):
        order = suffix_array(names)
        names = np.empty(len(order), np.int64)
        names[order] = np.arange(1, len(order) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    in_order = sample[np.argsort(names)]
    in_order = in_order[in_order < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.lexsort((rank[zero + 1], t[zero]))]
    # how many sampled suffixes of either kind stand before each of the others
    before = np.arange(len(zero))
    for r in (1, 2):
        mine = in_order[in_order % 3 == r]
        both = np.concatenate([mine, zero])
        columns = (t[both], rank[both + 1]) if r == 1 else (t[both], t[both + 1], rank[both + 2])
        key = _dense(*columns)
        before = before + np.searchsorted(key[: len(mine)], key[len(mine) :])
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[before] = False
    out[before] = zero
    out[rest] = in_order
    return out


def equal_prefixes(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, offset and class of each string of `length` bytes in the segments; equal strings have one class."""
    data = np.frombuffer(b"".join(x + b"\0" for x in segments), np.uint8)
    sizes = np.array([len(x) for x in segments])
    base = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(data), bool)
    inside[base + sizes] = False
    order = suffix_array(np.where(inside, data.astype(np.int64) + 2, 1))
    of = np.searchsorted(base, order, side="right") - 1
    fits = order - base[of] + length <= sizes[of]
    order, of = order[fits], of[fits]
    same = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
    for a in range(0, len(order) - 1, 1 << 15):  # neighbours, a bounded number at a time
        at = order[a : a + (1 << 15) + 1]
        rows = view[at]
        same[a + 1 : a + len(at)] = (rows[1:] == rows[:-1]).all(1)
    return of, order - base[of], np.cumsum(~same)


# ---------------------------------------------------------------- distributed

#: Positions of a group within which the symbols behind a position are looked up; the first ones of the next group are copied.
_GROUP = 1 << 13


def _ahead(rows: DataFrame, **wanted: tuple[str, int]) -> DataFrame:
    """rows (one for each position) with columns of later positions: name=(column, distance); 0 beyond the end."""
    far = max(k for _, k in wanted.values())
    group = F.floor(F.col("pos") / _GROUP)
    both = rows.withColumn("group", group).unionByName(rows.filter((F.col("pos") % _GROUP < far) & (F.col("pos") >= _GROUP)).withColumn("group", group - 1))
    w = Window.partitionBy("group").orderBy("pos")
    return both.withColumns({name: F.coalesce(F.lead(c, k).over(w), F.lit(0)) for name, (c, k) in wanted.items()}).filter(group == F.col("group")).drop("group")


def in_order(rows: DataFrame, by: list[str], same: list[str] | None = None, flag: str | None = None) -> tuple[DataFrame, int, str]:
    """rows in the order of the columns by, then pos, with place (from 0), name (from 1, equal for neighbours that agree on the columns same), seen (rows
    before with flag). Written as a table, whose path comes too, and the number of names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, same = rows.sparkSession, same or by
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("part", "place", "name", "seen"))])
    arrow = to_arrow_schema(schema)
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, name, seen = TaskContext.get().partitionId(), 0, 0, 0
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            values = [batch.column(names.index(c)) for c in same]
            for v in values:
                new[1:] |= pc.not_equal(v.slice(1), v.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            first = [v[0].as_py() for v in values]
            new[0] = first != last
            last = [v[n - 1].as_py() for v in values]
            mark = batch.column(names.index(flag)).to_numpy(zero_copy_only=False).astype(np.int64) if flag else np.zeros(n, np.int64)
            numbers = (np.full(n, part), place + np.arange(n), name + np.cumsum(new), seen + np.cumsum(mark) - mark)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *map(pa.array, numbers)], arrow, strict=True)], schema=arrow)
            place, name, seen = place + n, int(numbers[2][-1]), seen + int(mark.sum())

    ordered = rows.repartitionByRange(parts, *by, "pos").sortWithinPartitions(*by, "pos")
    table, path = store(ordered.mapInArrow(run, schema), "ordered")
    edge = F.struct(*same)
    extra = F.sum(F.col(flag).cast("long")) if flag else F.lit(0)
    ends = table.groupBy("part").agg(F.count("*").alias("n"), F.max("name").alias("names"), extra.alias("flags"), F.min_by(edge, "place").alias("first"), F.max_by(edge, "place").alias("last"))
    bases, n, total, flags, before = [], 0, 0, 0, None
    for r in sorted(ends.collect(), key=lambda r: r.part):  # a row for each partition
        total -= before is not None and before == r["first"]
        bases.append((r.part, n, total, flags))
        n, total, flags, before = n + r.n, total + r.names, flags + r.flags, r["last"]
    base = spark.createDataFrame(bases, "part long, base_place long, base_name long, base_seen long")
    numbered = table.join(F.broadcast(base), "part").withColumns({c: F.col(c) + F.col(f"base_{c}") for c in ("place", "name", "seen")})
    return numbered.select(*names, "place", "name", "seen"), total, path


def ranks(text: DataFrame, n: int, small: int = 1 << 18) -> DataFrame:
    """pos, rank (from 1) of the suffixes of a text given as pos (0 to n - 1) and sym (positive). A text of at most small symbols is sorted by one task."""
    spark = text.sparkSession
    if n <= max(3, small):

        def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if got:
                order = suffix_array(np.concatenate([b.column(1).to_numpy() for b in got]))
                yield pa.RecordBatch.from_pydict({"pos": order, "rank": np.arange(1, len(order) + 1)})

        return text.select("pos", "sym").repartition(1).sortWithinPartitions("pos").mapInArrow(whole, "pos long, rank long")
    ended = text.select("pos", "sym")
    extra = n % 3 == 1  # marks the end of the first part of the names
    if extra:
        ended = ended.unionByName(spark.createDataFrame([(n, 0)], "pos long, sym long"))
    triples = _ahead(ended, s1=("sym", 1), s2=("sym", 2)).filter("pos % 3 <> 0")
    named, names, path = in_order(triples, ["sym", "s1", "s2"])
    ones, third = len(range(1, n + extra, 3)), F.floor(F.col("pos") / 3)
    m = ones + len(range(2, n, 3))
    if names == m:
        sample = named.select("pos", F.col("name").alias("rank"))
    else:
        inner = named.select(F.when(F.col("pos") % 3 == 1, third).otherwise(ones + third).alias("pos"), F.col("name").alias("sym"))
        back = F.when(F.col("pos") < ones, F.col("pos") * 3 + 1).otherwise((F.col("pos") - ones) * 3 + 2)
        sample = ranks(inner, m, small).select(back.alias("pos"), "rank")
    # the mark is the smallest suffix
    sample = sample.filter(F.col("pos") < n).withColumn("rank", F.col("rank") - int(extra))
    known = text.select("pos", "sym").join(sample, "pos", "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))
    each, held = store(_ahead(known, s1=("sym", 1), r1=("rank", 1), r2=("rank", 2)), "ranked")
    drop_path(spark, path)
    kind = F.col("pos") % 3
    # the others stand among the sampled of one kind by a symbol and a rank, among those of the other kind by two symbols and a rank
    one, _, first = in_order(each.filter(kind != 2).select("pos", "rank", "sym", "r1", (kind == 1).alias("sampled")), ["sym", "r1"], flag="sampled")
    two, _, second = in_order(each.filter(kind != 1).select("pos", "rank", "sym", "s1", "r2", (kind == 2).alias("sampled")), ["sym", "s1", "r2"], flag="sampled")
    others = F.col("place") - F.col("seen")
    merged = one.filter("sampled").unionByName(two.drop("s1", "r2").filter("sampled").withColumn("r1", F.lit(0).cast("long"))).select("pos", (F.col("rank") + others).alias("rank"))
    zero = one.filter("not sampled").select("pos", (F.col("place") + 1).alias("a")).join(two.filter("not sampled").select("pos", F.col("seen").alias("b")), "pos")
    out, _ = store(merged.unionByName(zero.select("pos", (F.col("a") + F.col("b")).alias("rank"))), "ranks")
    for used in (held, first, second):
        drop_path(spark, used)
    return out


def prefix_classes(segments: DataFrame, length: int, small: int = 1 << 18) -> DataFrame:
    """Classes of equal strings of `length` bytes. segments: bytes and other columns; gives those, offset and class of each such string.

    Segments stand one after another, each with an end mark; neighbours in the order of suffixes are compared by their first `length` bytes.
    """
    others = [c for c in segments.columns if c != "bytes"]
    spark = segments.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*segments.select(*others, "bytes").schema.fields, T.StructField("part", T.LongType()), T.StructField("local", T.LongType())])
    arrow = to_arrow_schema(schema)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.array([len(x) + 1 for x in batch.column(len(others)).to_pylist()], np.int64)
            numbers = (np.full(len(sizes), part), at + np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, *map(pa.array, numbers)], arrow, strict=True)], schema=arrow)
            at += int(sizes.sum())

    table, _ = store(segments.select(*others, "bytes").mapInArrow(placed, schema), "segments")
    bases, n = [], 0
    for r in table.groupBy("part").agg(F.max(F.col("local") + F.length("bytes") + 1).alias("n")).orderBy("part").collect():  # a row for each partition
        bases.append((r.part, n))
        n += r.n
    if not n:
        return table.select(*others, F.lit(0).alias("offset"), F.lit(0).cast("long").alias("class"))
    based = table.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part").withColumn("base", F.col("base") + F.col("local"))

    def symbols(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sym = np.append(np.frombuffer(x, np.uint8).astype(np.int64) + 2, 1)
                yield pa.RecordBatch.from_pydict({"pos": base + np.arange(len(sym)), "sym": sym})

    text, path = store(based.select("base", "bytes").mapInArrow(symbols, "pos long, sym long"), "symbols")
    order = ranks(text, n, small)
    each = F.transform(F.sequence(F.lit(0), F.length("bytes") - length), lambda i: F.struct((F.col("base") + i).alias("pos"), i.alias("offset"), F.call_function("substring", F.col("bytes"), i + 1, F.lit(length)).alias("prefix")))
    prefixes = based.filter(F.length("bytes") >= length).select(*others, F.inline(each))
    classed, _, _ = in_order(prefixes.join(order, "pos").select(*others, "offset", "prefix", "pos", "rank"), ["rank"], same=["prefix"])
    drop_path(spark, path)
    return classed.select(*others, "offset", F.col("name").alias("class"))
