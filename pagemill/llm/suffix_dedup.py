"""Removal of repeated substrings by suffix arrays, built with the difference cover {1, 2} modulo 3.

A byte is removed if a string of `length` bytes that covers it also starts earlier in the corpus. Only strings that occur twice matter, and
those are found without sorting all suffixes of the corpus:

1. Each window of `length` bytes has an anchor, its 32-byte string of smallest hash, the leftmost of several. Equal windows have equal anchors
   at the same place, and about 3 positions in 100 are anchors. Their hashes are counted with pre-aggregation, and a bitmap of
   8 to 64 MB (two probes, 16 bits or more a hash up to 33 million hashes) takes the hashes that occur more than once. What passes by chance is sorted out below.
2. The context of an anchor is the text of all windows that have it. Of equal contexts all but the earliest repeat it whole. Where an anchor has several
   contexts, their earliest copies are cut to the windows that another one may hold too, and suffix arrays over them are built: sampled triples are
   sorted and named, the string of names is sorted by recursion while names repeat, the remaining suffixes are sorted by a byte and the rank behind it, and
   merged. Neighbours in the array are then compared over `length` bytes, byte by byte: runs of equal prefixes are the occurrences of a string, and all
   but the earliest are repeats. Anchors of up to 1 MB of contexts meet by their hash in a task, which sorts a bounded number of them at a time; larger
   ones, which very common strings have, go to one suffix array that the cluster sorts by ranges (suffix_array.py).
3. The repeated windows of a document, as intervals, meet its text, and the bytes they cover are cut out.

The reduction drops only windows whose anchor occurs once, and a suffix array over the rest decides. The bitmap holds any number of hashes; a full one
lets everything pass to step 2. Equal contexts are told by 128 bits: the anchor's hash and one of all their bytes. Two unlike contexts that agree
in both would count as one, so a string that isn't repeated could be cut; for 10^12 contexts of one corpus the probability of one such pair is about 10^-15.

Defined results. Null or empty text, or one shorter than `length`: nothing removed. Earlier means smaller key, then start; rows of one key with different texts are
ordered by a hash of the text, and equal rows are one document with one result each. A null key is the smallest. Texts of any length: long ones are worked
through in pieces that overlap. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, in_pieces, in_slices, mix64, shuffles_dropped, small_batches, span_hashes, store, stored
from .suffix_array import equal_prefixes, prefix_classes

ANCHOR = 32
#: Bits of a bitmap: as many as its hashes ask for, from 8 MB to 64 MB. A task puts together blocks of 2 ^ _BLOCK_BITS bits.
_BITS, _MOST_BITS, _BLOCK_BITS = 26, 29, 18
_LOW = np.uint64((1 << 28) - 1)


# ---------------------------------------------------------------- anchors


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(texts: list[bytes | None], length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window, last window (in the text), hash of the anchor, its place, two hashes of the run's bytes.

    A long text is cut into pieces that overlap by a window less a byte, which only splits runs.
    """
    found = [_anchors(of, offset, parts, length) for of, offset, parts in in_pieces(texts, overlap=length - 1)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _anchors(of: np.ndarray, offset: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(data) < length or sizes.max() < length:
        return none
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < ANCHOR:
        h = _joined(h[: len(h) - width], h[width:])
        width *= 2
    span = length - ANCHOR + 1  # anchors to choose from in a window
    low = (mix64(h) & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(data) - length + 1], low[span - width :][: len(data) - length + 1])
    at = (low & _LOW).astype(np.int64)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), np.maximum(0, sizes - length + 1))
    runs = np.maximum(0, sizes - length + 1)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + base[owner]
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    part = owner[first]
    back = offset[part] - base[part]
    context = span_hashes(data, start[first], start[last] + length)
    return of[part], start[first] + back, start[last] + back, h[at[first]], at[first] + back, context


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple((mix64(h + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 2))


def repeated_anchors(rows: DataFrame, length: int) -> np.ndarray:
    """Bitmap of the anchors' hashes that occur more than once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).to_pylist()
            for a, b in in_slices(texts):
                h, n = np.unique(anchors(texts[a:b], length)[3], return_counts=True)  # sums within the slice
                yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n.astype(np.int32)})

    counted = rows.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    return _bits_of(counted.select("h"))


def _bits_of(hashes: DataFrame, least: int = _BITS, most: int = _MOST_BITS) -> np.ndarray:
    """Bitmap of a column of hashes, with two bits for each among 16 or more, in 2^least to 2^most bits. Tasks put its blocks together."""
    spark = hashes.sparkSession
    table, path = store(hashes, "hashes")
    size = min(most, max(least, (16 * table.count()).bit_length()))

    def probed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probe = np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64), size))
            yield pa.RecordBatch.from_pydict({"block": (probe >> _BLOCK_BITS).astype(np.int32), "bit": (probe & ((1 << _BLOCK_BITS) - 1)).astype(np.int32)})

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = (batch.column(k).to_numpy() for k in (0, 1))
            order = np.argsort(block, kind="stable")
            block, bit = block[order], bit[order]
            first = np.flatnonzero(np.diff(block, prepend=-1))
            for k, i, j in zip(block[first].tolist(), first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
                made.setdefault(k, np.zeros(1 << _BLOCK_BITS, bool))[bit[i:j]] = True
        for k, x in made.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (size - 3), np.uint8)
    with shuffles_dropped(spark):
        got = table.mapInArrow(probed, "block int, bit int").repartition("block").mapInArrow(blocks, "block int, bits binary").toArrow()
    for k, x in zip(got.column("block").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[k << (_BLOCK_BITS - 3) : (k + 1) << (_BLOCK_BITS - 3)] = np.frombuffer(x, np.uint8)
    drop_path(spark, path)
    return out


def _passes(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for p in _probes(h, len(marks).bit_length() + 2):
        hit &= (marks[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return hit


def _place(key: np.ndarray, lo: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64(mix64(key.view(np.uint64)) + lo.astype(np.uint64)) ^ mix64(h.view(np.uint64))


def _contexts(rows: DataFrame, repeated: np.ndarray, length: int) -> DataFrame:
    """key, row, lo, hi (windows), h, context (hash of their bytes) of the anchors that the bitmap lets pass."""
    shared = rows.sparkSession.sparkContext.broadcast(repeated)  # 64 MB at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for a, b in in_slices(texts):
                text, lo, hi, h, _, context = anchors(texts[a:b], length)
                hit = _passes(shared.value, h)
                of = pa.array(text[hit])
                yield pa.RecordBatch.from_pydict({"key": batch.column(0).slice(a, b - a).take(of), "row": batch.column(1).slice(a, b - a).take(of), "lo": lo[hit], "hi": hi[hit], "h": h[hit].view(np.int64), "context": context[hit].view(np.int64)})

    return rows.select("key", "row", "text").mapInArrow(run, "key long, row long, lo long, hi long, h long, context long")


def _context_bytes(rows: DataFrame, places: np.ndarray, length: int) -> DataFrame:
    """key, row, lo, h, at (the anchor's place in the bytes), bytes of the contexts whose places the bitmap lets pass."""
    shared = rows.sparkSession.sparkContext.broadcast(places)  # 64 MB at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            keys = batch.column(0).to_numpy()
            for a, b in in_slices(texts):
                text, lo, hi, h, at, _ = anchors(texts[a:b], length)
                hit = _passes(shared.value, _place(keys[a:b][text], lo, h))
                text, lo, hi, h, at = text[hit], lo[hit], hi[hit], h[hit], at[hit]
                parts = [texts[a + t][i : j + length] for t, i, j in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                of = pa.array(text)
                yield pa.RecordBatch.from_pydict({"key": batch.column(0).slice(a, b - a).take(of), "row": batch.column(1).slice(a, b - a).take(of), "lo": lo, "h": h.view(np.int64), "at": (at - lo).astype(np.int32), "bytes": pa.array(parts, pa.binary())})

    return rows.select("key", "row", "text").mapInArrow(run, "key long, row long, lo long, h long, at int, bytes binary")


def _places(firsts: DataFrame) -> DataFrame:
    """The places of contexts as one hash each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"place": _place(*(batch.column(k).to_numpy() for k in range(3))).view(np.int64)})

    return firsts.select("key", "lo", "h").mapInArrow(run, "place long")


#: Windows of this many neighbouring extents share a probe.
_STEP = 18


def _trimmed(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts without the windows that can't be in another context of the anchor: h, key, row, lo, bytes.

    A window that begins l bytes before the anchor, with l from q to q + _STEP - 1, holds the probe of q: the length - _STEP + 1 bytes that begin q before the
    anchor. A window that stands in two contexts of an anchor stands at one place beside it, so its probe is in both of them.
    """
    n = F.length("bytes") - length + 1
    probes = []
    for q in range(0, length - ANCHOR + 1, _STEP):
        least, most = F.greatest(F.lit(q), F.col("at") - n + 1), F.least(F.lit(min(q + _STEP - 1, length - ANCHOR)), F.col("at"))
        probe = F.xxhash64(F.call_function("substring", F.col("bytes"), F.col("at") - q + 1, F.lit(length - _STEP + 1)))
        probes.append(F.when(least <= most, F.struct(F.lit(q).alias("q"), least.alias("least"), most.alias("most"), probe.alias("probe"))))
    each = contexts.select("h", "key", "row", "lo", F.inline(F.filter(F.array(*probes), lambda x: x.isNotNull())))
    here = F.struct("key", "row", "lo")
    shared = each.groupBy("h", "q", "probe").agg(F.min(here).alias("a"), F.max(here).alias("b")).filter("a <> b").select("h", "q", "probe")
    wanted = each.join(shared, ["h", "q", "probe"]).groupBy("h", "key", "row", "lo").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    cut = F.call_function("substring", F.col("bytes"), F.col("at") - F.col("most") + 1, F.col("most") - F.col("least") + length)
    return contexts.join(wanted, ["h", "key", "row", "lo"]).select("h", "key", "row", (F.col("lo") + F.col("at") - F.col("most")).alias("lo"), cut.alias("bytes"))


def _decide(contexts: DataFrame, length: int, most: int = 1 << 19) -> DataFrame:
    """key, row, from, to: the windows of contexts that repeat a window of another context of their anchor. An anchor's contexts are bounded."""

    def some(part: pa.RecordBatch) -> pa.RecordBatch:
        h, key, row, lo = (part.column(k).to_numpy() for k in range(4))
        order = np.lexsort((lo, row, key, h))
        new = np.ones(len(order), bool)  # equal rows are one document
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (h, key, row, lo)], axis=0)
        order = order[new]
        part, key, row, lo = part.take(pa.array(order)), key[order], row[order], lo[order]
        of, offset, group = equal_prefixes(part.column(4).to_pylist(), length)
        pos = lo[of] + offset
        order = np.lexsort((pos, row[of], key[of], group))
        of, pos, group = of[order], pos[order], group[order]
        repeat = np.zeros(len(of), bool)
        # equal strings of different anchors can't be, so a class is a string; its earliest occurrence stays
        repeat[1:] = group[1:] == group[:-1]
        of, pos = of[repeat], pos[repeat]
        order = np.lexsort((pos, of))
        of, pos = of[order], pos[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(of))[: len(first)] - 1
        return pa.RecordBatch.from_pydict({"key": key[of[first]], "row": row[of[first]], "from": pos[first], "to": pos[last]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(keep_last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = whole.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if keep_last else len(h)  # an anchor's contexts stay together
            rest = whole.slice(cut)
            held, size = [rest] if rest.num_rows else [], rest.nbytes
            now = whole.slice(0, cut)
            h = h[:cut]
            several = np.zeros(cut, bool)
            several[1:] |= h[1:] == h[:-1]
            several[:-1] |= h[1:] == h[:-1]
            if several.any():
                yield some(now.filter(pa.array(several)))

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from flush(True)
        if held:
            yield from flush(False)

    rows = contexts.repartition(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h").select("h", "key", "row", "lo", "bytes")
    return rows.mapInArrow(run, "key long, row long, from long, to long")


def _decide_sorted(contexts: DataFrame, length: int, small: int) -> DataFrame:
    """Like _decide, for contexts of any number, by one suffix array over all of them, sorted by the cluster."""
    classes = prefix_classes(contexts.select("h", "key", "row", "lo", "bytes").dropDuplicates(["h", "key", "row", "lo"]), length, small)
    each = classes.select("class", "key", "row", (F.col("lo") + F.col("offset")).alias("from"))
    first = each.groupBy("class").agg(F.min(F.struct("key", "row", "from")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("class", "first")
    return each.join(first, "class").filter(F.struct("key", "row", "from") != F.col("first")).select("key", "row", "from", F.col("from").alias("to"))


def repeated_windows(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", task_bytes: int = 1 << 20, small: int = 1 << 18) -> DataFrame:
    """key, row (hash of the text), from, to: starts of the strings of `length` bytes that also start earlier, as intervals.

    An anchor whose contexts hold more than task_bytes goes to the suffix array that the cluster sorts; the others fit into a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = F.col(text).cast("string")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(plain).alias("row"), F.encode(plain, "UTF-8").alias("text"))
    found, all_contexts = store(_contexts(rows, repeated_anchors(rows, length), length), "contexts")
    here = F.struct("key", "row", "lo")
    earliest, firsts = store(found.groupBy("h", "context").agg(F.min(here).alias("at")), "earliest")
    later = stored(_merged(found.join(earliest, ["h", "context"]).filter(here != F.col("at")).select("key", "row", F.col("lo").alias("from"), F.col("hi").alias("to"))), "later")
    drop_path(spark, all_contexts)
    # anchors with several contexts: the text of the earliest copy of each is looked at again
    several = earliest.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    places = _bits_of(_places(earliest.join(several, "h").select("at.key", "at.lo", "h")))
    drop_path(spark, firsts)
    looked, seen = store(_context_bytes(rows, places, length), "texts")
    held = stored(_trimmed(looked, length), "trimmed")
    drop_path(spark, seen)
    large = held.groupBy("h").agg(F.sum(F.length("bytes")).alias("n")).filter(F.col("n") > task_bytes).select("h")
    repeats = _decide(held.join(large, "h", "left_anti"), length)
    if not large.isEmpty():
        repeats = repeats.unionByName(_decide_sorted(held.join(large, "h", "left_semi"), length, small))
    each = F.arrays_zip(F.col("begins").alias("from"), F.col("ends").alias("to"))
    return repeats.unionByName(later.select("key", "row", F.inline(each)))


def _merged(spans: DataFrame) -> DataFrame:
    """key, row, begins, ends of the intervals (key, row, from, to) of a document, those that touch each other as one."""
    lists = spans.groupBy("key", "row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            owner = np.repeat(np.arange(n), batch.column(2).value_lengths().to_numpy())
            begin, end = (x.to_numpy() for x in batch.column(2).flatten().flatten())
            order = np.lexsort((begin, owner))
            owner = owner[order]
            base = owner << 40
            begin, top = begin[order] + base, np.maximum.accumulate(end[order] + base)
            new = np.ones(len(owner), bool)
            new[1:] = begin[1:] > top[:-1] + 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(owner))[: len(first)] - 1
            cuts = pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (begin[first] - base[first], top[last] - base[first])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["key", "row", "begins", "ends"])

    return lists.mapInArrow(run, "key long, row long, begins array<long>, ends array<long>")


def cut(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """key, kept (bytes that are left), n_bytes, n_removed, n_spans. limits: those of repeated_windows."""
    plain = F.col(text).cast("string")
    spans = stored(_merged(repeated_windows(docs, length, key, text, **limits)), "spans")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(plain).alias("row"), F.encode(F.coalesce(plain, F.lit("")), "UTF-8").alias("text"))
    joined = rows.join(spans, ["key", "row"], "left").select("id", "text", "begins", "ends")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            for t, begins, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                gone = np.zeros(len(t) + 1, np.int32)
                if begins:
                    np.add.at(gone, begins, 1)
                    np.add.at(gone, np.array(ends) + length, -1)
                mask = np.cumsum(gone[:-1]) > 0
                out["kept"].append(np.frombuffer(t, np.uint8)[~mask].tobytes() if begins else t)
                out["n_bytes"].append(len(t))
                out["n_removed"].append(int(mask.sum()))
                out["n_spans"].append(int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "kept": pa.array(out.pop("kept"), pa.binary())} | {k: pa.array(v, pa.int64()) for k, v in out.items()})

    return joined.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")
